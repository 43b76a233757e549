"""Chain roots against a loop, with branches, rings and ways into them."""

import random

from loamgraph.operators import backfill as O


def loop(up):
    out = {}
    for i in up:
        seen, cur = set(), i
        while up.get(cur) in up and cur not in seen:
            seen.add(cur)
            cur = up[cur]
        out[i] = cur
    return out


def test_roots_against_a_loop(spark):
    r = random.Random(5)
    up = {k: r.choice([None, k - 1, r.randrange(200), 9999]) for k in range(200)} | {300 + k: 300 + (k + 1) % 5 for k in range(5)} | {400: 302, 401: 400, 402: 402} | {500 + k: 499 + k if k else None for k in range(150)}
    got = O.roots(spark.createDataFrame(list(up.items()), "id long, up long"))
    assert dict(map(tuple, got.collect())) == loop(up)
    assert O.roots(spark.createDataFrame([], "id long, up long")).count() == 0


def test_branches_nodes_and_edges(spark):
    rows = [(1, None, 3), (2, None, 3), (3, None, 4), (4, "kept", None), (5, None, 6), (6, None, 5), (7, "own", None), (8, None, None)]
    m = spark.createDataFrame(rows, "id long, node_uuid string, migrated_to long")
    assert dict(map(tuple, O.nodes_of(m).collect())) == {1: "m-1", 2: "kept", 3: "kept", 4: "kept", 5: "m-5", 6: "m-6", 7: "own", 8: "m-8"}
    paths = [("core", "a", 4, 2, None), ("core", "a/b", 7, None, "x"), ("core", "zz/b", 7, 5, None), ("core", "a/b/c", 8, 1, None), ("side", "b", 7, 9, "y"), ("core", "lost", 99, 1, None)]
    _, edges, new = O.graph_of(m, spark.createDataFrame(paths, "domain string, path string, memory_id long, priority int, disclosure string"))
    assert sorted(map(tuple, edges.collect())) == [(1, "ROOT", "kept", "a", 2, None), (2, "ROOT", "own", "b", 9, "y"), (3, "kept", "own", "b", 0, "x"), (4, "own", "m-8", "c", 1, None)]
    assert sorted((x.domain, x.path, x.edge_id) for x in new.collect()) == [("core", "a", 1), ("core", "a/b", 3), ("core", "a/b/c", 4), ("core", "zz/b", 2), ("side", "b", 2)]


def test_many_rings_take_no_more_rounds(spark, monkeypatch):
    """Rounds follow the longest way, not the number of ids on rings."""
    made = []
    plain = O.cut
    monkeypatch.setattr(O, "cut", lambda df: made.append(1) or plain(df))

    def rounds(rings):
        made.clear()
        up = {10 * k + j: 10 * k + (j + 1) % 3 for k in range(rings) for j in range(3)} | {10 * k + 3: 10 * k + 1 for k in range(rings)}
        assert dict(map(tuple, O.roots(spark.createDataFrame(list(up.items()), "id long, up long")).collect())) == loop(up)
        return len(made)

    assert rounds(2) == rounds(300)
