"""Aliases with what forbids them, and the lines of the report, by hand."""

from loamgraph.operators import alias as O

PATH = "namespace string, domain string, path string, edge_id long, node_uuid string"
EDGE = "id long, parent_uuid string, child_uuid string, name string, priority int, disclosure string"
REQ = "seq long, namespace string, domain string, path string, target_domain string, target_path string, priority int, disclosure string"


def test_statuses_and_inherited_fields(spark):
    edges = spark.createDataFrame([(1, "ROOT", "a", "a", 1, "note a"), (2, "a", "b", "b", 2, ""), (3, "b", "c", "c", 3, None), (4, "ROOT", "z", "z", 0, None)], EDGE)
    paths = spark.createDataFrame([("", "core", "a", 1, "a"), ("", "core", "a/b", 2, "b"), ("", "core", "a/b/c", 3, "c"), ("", "core", "z", 4, "z")], PATH)
    rows = [
        (1, "", "core", "", "core", "a", None, None), (2, "", "core", "x", "core", "nope", None, None), (3, "", "core", "no/x", "core", "a", None, None), (4, "", "core", "z", "core", "a", None, None),
        (5, "", "core", "a/b/c/x", "core", "a", None, None), (6, "", "core", "a/b/x", "core", "a/b", None, None), (7, "", "core", "z/w", "core", "a", 5, None), (8, "", "core", "z/w", "core", "a/b", 5, "own"),
        (9, "", "core", "a/again", "core", "a/b", 9, "own"), (10, "", "side", "r", "core", "a/b/c", None, "own"), (11, "other", "core", "q", "core", "a", None, None),
    ]
    got = {x.seq: tuple(x)[1:] for x in O.alias(paths, edges, spark.createDataFrame(rows, REQ)).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "root", 2: "no target", 3: "no parent", 4: "taken", 5: "cycle", 6: "cycle", 7: "ok", 8: "taken", 9: "ok", 10: "ok", 11: "no target"}
    assert got[7] == ("ok", "z", "a", "w", 5, "note a", None) and got[9] == ("ok", "a", "b", "b", 2, "", 2) and got[10] == ("ok", "ROOT", "c", "r", 0, "own", None)
    assert O.alias(paths, edges, spark.createDataFrame(rows, REQ).where("false")).count() == 0


def test_report_lines(spark):
    stale = spark.sql("SELECT 'core://b' AS uri, 1 AS priority, 9.5D AS stale_days, 7L AS threshold, timestamp'2024-01-02 03:04:05' AS last UNION ALL SELECT 'core://a', 0, 4.0D, 3L, null")
    crowded = spark.sql("SELECT 'core://p' AS uri, 12L AS n_children")
    orphaned = spark.sql("SELECT 'core://x/y' AS uri, CAST(null AS BIGINT) AS memory_id, timestamp'2024-01-02 00:00:00' AS created")
    twice = spark.sql("SELECT 'core' AS domain, '' AS parent, 5L AS memory_id, array('m', 'n') AS paths")
    got = [x.text for x in O.report(stale, crowded, orphaned, twice).orderBy("section", "n", "line").collect()]
    assert got == [
        "1. core://a", "   Priority: 0 | Stale for: ~4.0 days (Threshold: 3 days) | Never accessed (since tracking began)", "2. core://b", "   Priority: 1 | Stale for: ~9.5 days (Threshold: 7 days) | Last Accessed: 2024-01-02",
        "1. core://p (12 children)", "1. core://x/y", "   No active memory | Created: 2024-01-02", "1. Memory ID: 5", "   Parent: core://", "   Duplicate Paths (2):", "     - core://m", "     - core://n",
    ]
