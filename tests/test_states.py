"""Versions and parents in batches against loops that take requests one by one."""

import random

from loamgraph.operators import states as O

LINK = "child string, parent string"


def chain(n, entity="e"):
    return [(f"{entity}_v{k}", entity, k, f"n{k}", f"t{k}", k % 2 == 0, f"{entity}_v{k - 1}" if k > 1 else None) for k in range(1, n + 1)]


def test_removal_against_a_loop(spark):
    """One state after the other, in any order, gives what the batch gives."""
    r = random.Random(21)
    states = [s for k in range(6) for s in chain(r.randint(1, 40), f"e{k}")]
    current = [(f"e{k}", r.choice([s for s in states if s[1] == f"e{k}"])[0]) for k in range(6)]
    refs = [(s[0], r.randint(0, 2)) for s in states if r.random() < 0.1]
    asked = [s[0] for s in states if r.random() < 0.8] + ["nobody", "nobody"]
    prev, at, busy = {s[0]: s[6] for s in states}, dict(current), {i for i, n in refs if n}
    for i in r.sample(asked, len(asked)):
        if i in prev and i not in busy:
            at = {e: prev[i] if c == i else c for e, c in at.items()}
            prev = {k: prev[i] if p == i else p for k, p in prev.items() if k != i}
    answers, left, now = O.removed(spark.createDataFrame(states, O.STATES), spark.createDataFrame(current, "entity_id string, id string"), spark.createDataFrame(refs, "id string, n int"), spark.createDataFrame([(a,) for a in asked], "id string"))
    assert {x.id: x.previous for x in left.collect()} == prev and dict(map(tuple, now.collect())) == at
    assert {x.id: x.status for x in answers.collect()} == {a: "not found" if a == "nobody" else "referenced" if a in busy else "ok" for a in asked}


def test_a_long_run_and_a_ring(spark):
    states = chain(300) + [("a", "r", 1, "", "", True, "b"), ("b", "r", 2, "", "", True, "a"), ("c", "r", 3, "", "", True, "b")]
    gone = [(f"e_v{k}",) for k in range(2, 300)] + [("a",), ("b",)]
    _, left, now = O.removed(spark.createDataFrame(states, O.STATES), spark.createDataFrame([("e", "e_v299"), ("r", "a")], "entity_id string, id string"), spark.createDataFrame([], "id string, n int"), spark.createDataFrame(gone, "id string"))
    assert {x.id: x.previous for x in left.collect()} == {"e_v1": None, "e_v300": "e_v1", "c": None}
    assert dict(map(tuple, now.collect())) == {"e": "e_v1", "r": None}


def test_new_versions_in_order(spark):
    states = chain(3) + chain(1, "f")
    rows = [(5, "e", None, "c5", None), (2, "e", "named", "c2", None), (9, "e", None, "c9", True), (3, "f", None, "c3", False), (4, "none", "x", "y", True)]
    req = spark.createDataFrame(rows, "seq long, entity_id string, name string, content string, inheritable boolean")
    answers, new, now = O.updated(spark.createDataFrame(states, O.STATES), req)
    assert sorted((x.id, x.name, x.content, x.inheritable, x.previous) for x in new.collect()) == [("e_v4", "named", "c2", False, "e_v3"), ("e_v5", "named", "c5", False, "e_v4"), ("e_v6", "named", "c9", True, "e_v5"), ("f_v2", "n1", "c3", False, "f_v1")]
    assert dict((x.seq, x.id) for x in answers.collect()) == {2: "e_v4", 5: "e_v5", 9: "e_v6", 3: "f_v2", 4: None}
    assert dict(map(tuple, now.collect())) == {"e": "e_v6", "f": "f_v2"}


def test_links_against_a_loop(spark):
    r = random.Random(8)
    names = [f"n{k}" for k in range(6)]
    start = {("n0", "n1"), ("n2", "n3"), ("n3", "n2"), ("n4", "n5")}
    rows = [(k, r.choice(["link", "link", "unlink"]), *(r.choice([("n0", "n1"), ("n1", "n0")]) if r.random() < 0.4 else (r.choice([*names, "zz"]), r.choice(names)))) for k in range(500)]
    links, want = set(start), {}
    for k, op, c, p in rows:
        if c == p:
            want[k] = "self"
        elif "zz" in (c, p):
            want[k] = "no entity"
        elif op == "link":
            want[k] = "exists" if (c, p) in links else "mutual" if (p, c) in links else "ok"
            links |= {(c, p)} if want[k] == "ok" else set()
        else:
            want[k] = "ok" if (c, p) in links else "missing"
            links -= {(c, p)}
    req = spark.createDataFrame(rows, "seq long, op string, child string, parent string").repartition(7)
    entities = spark.createDataFrame([(n,) for n in names], "id string")
    answers, left = O.belonging(entities, spark.createDataFrame(sorted(start), LINK), req)
    assert dict(map(tuple, answers.collect())) == want and set(map(tuple, left.collect())) == links
    none = O.belonging(entities, spark.createDataFrame(sorted(start), LINK), req.where("false"))
    assert none[0].count() == 0 and set(map(tuple, none[1].collect())) == start
