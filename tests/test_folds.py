"""Batches of dependent requests against a loop that takes them one by one."""

import random

from pyspark.sql import functions as F

from loamgraph.operators import folds as O

STAR = "namespace string, domain string, path string, edge_id long, node_uuid string, memory_id long, priority int, disclosure string, world_timestamp string"
MEM = "id long, node_uuid string, content string, deprecated boolean, migrated_to long, world_timestamp string"
REQ = "seq long, namespace string, domain string, path string, content string, priority int, disclosure string, world_timestamp string"


def loop(star, memories, requests):
    """The same by hand: every request upon what the last has left."""
    at = {(s[0], s[1], s[2]): s for s in star}
    mem = {m[0]: dict(zip(("id", "node", "content", "dep", "to", "world"), m)) for m in memories}
    edge = {s[3]: [s[6], s[7]] for s in star}
    had, before = {k: tuple(v) for k, v in edge.items()}, {k: tuple(v.values()) for k, v in mem.items()}
    active = {s[4]: s[5] for s in star}
    ids, answers = max(mem) + 1, []
    for seq, ns, domain, path, content, priority, note, world in sorted(requests):
        if content is None and priority is None and note is None and world is None:
            answers.append((seq, "nothing", at[ns, domain, path][4] if (ns, domain, path) in at else None, None, None))
            continue
        if (ns, domain, path) not in at:
            answers.append((seq, "not found", None, None, None))
            continue
        s = at[ns, domain, path]
        if priority is not None:
            edge[s[3]][0] = priority
        if note is not None:
            edge[s[3]][1] = note
        old = active[s[4]]
        if content is not None:
            mem[ids] = {"id": ids, "node": s[4], "content": content, "dep": False, "to": None, "world": world if world is not None else mem[old]["world"]}
            mem[old].update(dep=True, to=ids)
            active[s[4]] = ids
            ids += 1
        elif world is not None:
            mem[old]["world"] = world
        answers.append((seq, "ok", s[4], old, active[s[4]]))
    rows = sorted(tuple(v.values()) for k, v in mem.items() if before.get(k) != tuple(v.values()))
    return sorted(answers), rows, sorted((k, *had[k], *v) for k, v in edge.items() if had[k] != tuple(v))


def test_updates_against_a_loop(spark):
    r = random.Random(9)
    star = [("", "core", f"p{k}", 100 + k, f"n{k // 2}", 10 + k // 2, k % 3, None if k % 2 else "x", None if k % 4 else "2020") for k in range(12)]
    memories = [(10 + k, f"n{k}", f"old {k}", False, None, None if (2 * k) % 4 else "2020") for k in range(6)] + [(3, "n0", "older", True, 10, None)]
    star = [(*s[:8], {m[0]: m[5] for m in memories}[s[5]]) for s in star]
    maybe = lambda x: x if r.random() < 0.5 else None
    requests = [(k, "", "core", f"p{r.choice([0, 0, 0, 1, 1, 2, 3, 5, 8, 99])}", maybe(f"c{k}"), maybe(k % 5), maybe(f"d{k % 3}"), maybe(f"w{k}")) for k in r.sample(range(1000), 120)]
    answers, versions, edges = O.update(spark.createDataFrame(star, STAR), spark.createDataFrame(memories, MEM), spark.createDataFrame(requests, REQ).repartition(5))
    want = loop(star, memories, requests)
    assert sorted(map(tuple, answers.collect())) == want[0]
    assert sorted((x.id, x.node_uuid, x.content, x.deprecated, x.migrated_to, x.world_timestamp) for x in versions.collect()) == want[1]
    assert sorted((x.edge_id, x.had_priority, x.had_disclosure, x.priority, x.disclosure) for x in edges.collect()) == want[2]
    none = spark.createDataFrame(requests, REQ).where("false")
    assert [x.count() for x in O.update(spark.createDataFrame(star, STAR), spark.createDataFrame(memories, MEM), none)] == [0, 0, 0]


def test_running_values_with_one_hot_key(spark):
    r = random.Random(4)
    rows = [("hot" if k % 3 else f"k{k % 7}", k, r.choice([None, k]), r.choice([None, None, f"v{k}"])) for k in range(900)]
    df = spark.createDataFrame(rows, "k string, s long, a long, b string").repartition(6)
    got = {x.s: (x.n, x.last) for x in O.running(df, ["k"], ["s"], {"n": "a"}, {"last": "b"}).collect()}
    state, want = {}, {}
    for k, s, a, b in rows:
        n, last = state.get(k, (0, None))
        state[k] = want[s] = (n + (a is not None), b if b is not None else last)
    assert got == want
    assert O.running(df.where("false"), ["k"], ["s"], {"n": "a"}).count() == 0
    assert df.select(F.max("s")).first()[0] == 899


def test_running_values_over_a_split_key(spark, monkeypatch):
    r = random.Random(5)
    rows = [("hot" if k % 3 else f"k{k % 7}", k // 4, k % 4, r.choice([None, k]), r.choice([None] * 9 + [f"v{k}"])) for k in range(900)]
    df = spark.createDataFrame(rows, "k string, s long, t int, a long, b string").repartition(6)
    monkeypatch.setattr(O, "SPLIT", 40)
    out = O.running(df, ["k"], ["s", "t"], {"n": "a"}, {"last": "b"})
    assert out.columns == ["k", "s", "t", "a", "b", "n", "last"]
    state, want = {}, {}
    for k, s, t, a, b in rows:
        n, last = state.get(k, (0, None))
        state[k] = want[s, t] = (n + (a is not None), b if b is not None else last)
    assert {(x.s, x.t): (x.n, x.last) for x in out.collect()} == want
