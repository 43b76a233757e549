"""Pools of row changes: batch and stream against a loop over the events."""

import random

from loamgraph.operators import pool as O
from loamgraph.operators.steps import scratch
from loamgraph.streaming import pool as stream


def made(seed, n=400):
    r = random.Random(seed)
    kinds = ["record"] * 4 + ["approve", "restore", "remove"]
    maybe = lambda x: x if r.random() < 0.7 else None
    return [(k, k // 150, r.choice(kinds), "hot" if r.random() < 0.4 else f"r{r.randrange(25)}", maybe(f"b{k}"), maybe(f"a{k}")) for k in range(n)]


def loop(events):
    state = {}
    for e in events:
        state[e[3]] = O.fold(state.get(e[3]), [(e[0], e[1], e[2], e[4], e[5])])
    return sorted(((k, *v) for k, v in state.items() if v), key=repr)


def test_fold_by_hand():
    at = lambda *kinds: O.fold(None, [(k, h, x, f"b{k}", f"a{k}") for k, (x, h) in enumerate(kinds)])
    assert at(("approve", 0), ("remove", 0)) is None
    assert at(("record", 0), ("record", 0)) == (0, "b0", "a1", "pending", 2)
    assert at(("record", 0), ("approve", 0)) == (0, "b0", "a0", "approved", 1)
    assert at(("record", 0), ("approve", 0), ("record", 0)) == (0, "b0", "a2", "pending", 2)
    assert at(("record", 0), ("restore", 0)) == (0, "b0", "b0", "pending", 1)
    assert at(("record", 0), ("record", 1)) == (1, "b1", "a1", "pending", 1)
    assert at(("record", 0), ("approve", 1)) is None and at(("record", 0), ("remove", 0), ("record", 0)) == (0, "b2", "a2", "pending", 1)


def test_batch_and_stream_against_a_loop(spark):
    events = made(3)
    df = spark.createDataFrame(events, O.EVENTS)
    want = loop(events)
    assert sorted(map(tuple, O.pooled(df.repartition(5)).collect()), key=repr) == want
    base = scratch(spark, "pool-test")
    for k in range(2):  # the second run goes on with the state of the first
        df.where(f"seq div 250 = {k}").coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream.run(spark.readStream.schema(O.EVENTS).parquet(f"{base}/in"), f"{base}/out", f"{base}/state", 2)
        upto = loop(events[: 250 * (k + 1)])
        assert sorted(map(tuple, stream.current(spark, f"{base}/out").collect()), key=repr) == upto
    assert O.pooled(df.where("false")).count() == 0
