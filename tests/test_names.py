"""Free names against a loop, and records by hand."""

import random

from loamgraph.operators import names as O


def test_free_names_against_a_loop(spark):
    r = random.Random(14)
    taken = {r.choice("abc") + r.choice(["", "_1", "_2", "_4", "_7", "_01", "_x"]) for _ in range(14)} | {f"hot_{k}" for k in range(0, 200, 3)}
    wanted = [(k, "hot" if k % 3 else r.choice(["a", "b", "c", "d", "a_1", "d_2", "b_1_1"])) for k in r.sample(range(5000), 400)]
    asked, used, want = {p for _, p in wanted}, set(taken), {}
    for k, p in sorted(wanted):
        n, name = 0, p
        while name in used or n and name in asked:
            n += 1
            name = f"{p}_{n}"
        used.add(name)
        want[k] = name
    got = O.free_names(spark.createDataFrame([(t,) for t in taken], "path string"), spark.createDataFrame(wanted, "seq long, path string").repartition(5)).collect()
    assert {x.seq: x.free_path for x in got} == want and len(set(want.values())) == len(wanted)


def test_records_by_hand(spark):
    rows = [(1, "ann", "x"), (2, "rel:ann>bob", "@relation: knows\n\nsince school"), (3, "chap:ann>bob:first: day", "rain"), (4, "rel:zed>bob", "y"), (5, "relay__q", "z"), (6, "ann", "again"), (7, "chap:ann>bob:end", None)]
    got = O.imported(spark.createDataFrame(rows, "seq long, id string, content string"), spark.createDataFrame([("ann_1",)], "path string"))
    assert sorted(map(tuple, got.collect())) == [
        (1, "entity", "ann", None, "x", "ok"), (2, "relation", "ann/bob", "knows", "since school", "ok"), (3, "chapter", "ann/bob:first/ day", None, "rain", "no parent"), (4, "relation", "zed/bob", None, "y", "no parent"),
        (5, "relay", "relay__q", None, "z", "relay"), (6, "entity", "ann_2", None, "again", "ok"), (7, "chapter", "ann/bob/end", None, None, "ok"),
    ]


def test_records_of_one_seq(spark):
    """Each record of a seq comes once for every path that a record of the seq gets; those without a path keep to the others'."""
    rows = [(1, "ann", "x"), (2, "bob", "y"), (2, "ann", "z"), (3, "rel:zed>bob", "v"), (3, "cid", "w"), (4, "relay__q", "r"), (4, "relay__p", "s")]
    got = O.imported(spark.createDataFrame(rows, "seq long, id string, content string"), spark.createDataFrame([("cid",)], "path string"))
    assert sorted((x.seq, x.path, x.content, x.status) for x in got.collect()) == [
        (1, "ann", "x", "ok"), (2, "ann_1", "y", "ok"), (2, "ann_1", "z", "ok"), (2, "bob", "y", "ok"), (2, "bob", "z", "ok"),
        (3, "cid_1", "v", "no parent"), (3, "cid_1", "w", "ok"), (4, "relay__p", "s", "relay"), (4, "relay__q", "r", "relay"),
    ]
