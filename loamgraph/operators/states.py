"""Versions of entities as chains: new ones in a batch, simultaneous removal, and parents linked and unlinked in order."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import running
from .steps import cut, table

STATES = "id string, entity_id string, version long, name string, content string, inheritable boolean, previous string"


def skipped(gone: DataFrame) -> DataFrame:
    """(id, goal) of gone(id, goal): the first goal from each id on that is not gone itself; null where none comes, as at
    the end of a chain or in a ring. Pointers double until no goal is gone."""
    at, n, step = cut(gone.select("id", "goal")), gone.count(), 1
    far = lambda df: df.select(F.col("id").alias("goal"), F.col("goal").alias("goal2"), F.lit(True).alias("dead"))
    while step <= 2 * n and not at.join(far(at), "goal", "left_semi").isEmpty():
        at = cut(at.join(far(at), "goal", "left").select("id", F.when(F.col("dead"), F.col("goal2")).otherwise(F.col("goal")).alias("goal")))
        step *= 2
    return at.join(gone.select(F.col("id").alias("goal"), F.lit(True).alias("dead")), "goal", "left").select("id", F.when(F.col("dead").isNull(), F.col("goal")).alias("goal"))


def removed(states: DataFrame, current: DataFrame, references: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answers, states, current) of requests(id): all of a batch at once.

    references(id, n): edges that lead to a state from others, which refuse its removal; its own edges do not. The states
    that stay have the next state that stays as previous. Where the current state of current(entity_id, id) goes, the entity falls
    back to the first one before it that stays, or to none (null). answers: (id, status, n): 'not found', 'referenced' with
    the number of edges, or 'ok'.
    """
    refs = references.groupBy("id").agg(F.sum("n").alias("n")).where("n > 0")
    asked = requests.select("id").distinct().join(states.select("id", "previous", F.lit(True).alias("there")), "id", "left").join(refs, "id", "left")
    status = F.when(F.col("there").isNull(), "not found").when(F.col("n").isNotNull(), "referenced").otherwise("ok")
    asked = cut(asked.select("id", "previous", status.alias("status"), F.coalesce("n", F.lit(0)).alias("n")))
    gone = asked.where("status = 'ok'").select("id", F.col("previous").alias("goal"))
    over = cut(skipped(gone)).select(F.col("id").alias("g"), "goal", F.lit(True).alias("dead"))
    at = lambda df, c: df.join(over, F.col(c) == F.col("g"), "left").withColumn(c, F.when(F.col("dead"), F.col("goal")).otherwise(F.col(c))).drop("g", "goal", "dead")
    left = states.join(gone.select("id"), "id", "left_anti")
    return asked.select("id", "status", "n"), at(left, "previous").select(states.columns), at(current, "id").select("entity_id", "id")


def updated(states: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answers, states, current) of requests(seq, entity_id, name, content, inheritable), in the order of seq.

    Each makes the version after the entity's highest, whatever is current; a null name or inheritable is taken over from
    the version before. answers: (seq, status, id): 'no entity' without any version, else 'ok' with the new one's id.
    states: the new rows; current: (entity_id, id) of the entities that have new ones.
    """
    top = states.groupBy("entity_id").agg(F.max(F.struct("version", "id", "name", "inheritable")).alias("top"))
    got = cut(requests.join(top, "entity_id", "left"))
    ok = got.where("top is not null")
    at = running(ok, ["entity_id"], ["seq"], {"k": "seq"}, {"named": "name", "inherits": "inheritable"})
    version = F.col("top.version") + F.col("k")
    new_id = lambda v: F.concat("entity_id", F.lit("_v"), v.cast("string"))
    new = at.select(
        "seq", new_id(version).alias("id"), "entity_id", version.alias("version"), F.coalesce("named", "top.name").alias("name"), "content", F.coalesce("inherits", "top.inheritable").alias("inheritable"),
        F.when(F.col("k") == 1, F.col("top.id")).otherwise(new_id(version - 1)).alias("previous"),
    )
    new = cut(new)
    answers = new.select("seq", F.lit("ok").alias("status"), "id").unionByName(got.where("top is null").select("seq", F.lit("no entity").alias("status"), F.lit(None).cast("string").alias("id")))
    return answers, new.drop("seq"), new.groupBy("entity_id").agg(F.max_by("id", "version").alias("id"))


def belonging(entities: DataFrame, links: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers, links) of requests(seq, op, child, parent) with op 'link' or 'unlink', in the order of seq.

    answers: (seq, status): 'self', 'no entity', 'exists', 'mutual' (the parent already belongs to the child), 'missing'
    (nothing to unlink) or 'ok'. links: (child, parent) as the batch leaves them.

    Only requests of one unordered pair depend on each other, and they see four states (either link there or not). A
    request is a function of these states; functions compose, so a task composes those of its range of (pair, seq), and
    where a range starts comes from one function for each range and pair before it. One pair may have a third of all requests.
    """
    lo, hi = F.least("child", "parent"), F.greatest("child", "parent")
    known = lambda c: entities.select(F.col("id").alias(c), F.lit(True).alias(f"has_{c}"))
    got = requests.join(known("child"), "child", "left").join(known("parent"), "parent", "left")
    bad = F.when(F.col("child") == F.col("parent"), "self").when(F.col("has_child").isNull() | F.col("has_parent").isNull(), "no entity")
    got = cut(got.withColumn("bad", bad))
    code = F.when(F.col("op") == "link", 0).otherwise(2) + (F.col("child") > F.col("parent")).cast("int")
    open_ = got.where("bad is null").select("seq", lo.alias("lo"), hi.alias("hi"), code.alias("code"))
    dealt = open_.repartitionByRange("lo", "hi", "seq").sortWithinPartitions("lo", "hi", "seq").withColumn("_i", F.monotonically_increasing_id())
    # bit 0: the lower one belongs to the higher, bit 1: the other way; what each request makes of 0 to 3
    table = [[1 if s == 0 else s for s in range(4)], [2 if s == 0 else s for s in range(4)], [s & 2 for s in range(4)], [s & 1 for s in range(4)]]

    def compose(batches):
        pair, f = None, None
        for batch in batches:
            lows, highs, codes = (batch.column(k).to_pylist() for k in (1, 2, 3))
            before, after = [], []
            for x in zip(lows, highs, codes):
                if x[:2] != pair:
                    pair, f = x[:2], (0, 1, 2, 3)
                before.append(sum(s << 2 * k for k, s in enumerate(f)))
                f = tuple(table[x[2]][s] for s in f)
                after.append(sum(s << 2 * k for k, s in enumerate(f)))
            yield pa.record_batch([*batch.columns, pa.array(before, pa.int32()), pa.array(after, pa.int32())], names=[*batch.schema.names, "before", "after"])

    each = cut(dealt.mapInArrow(compose, "seq long, lo string, hi string, code int, _i long, before int, after int")).withColumn("_r", F.shiftright("_i", 33))
    had = links.select(F.least("child", "parent").alias("lo"), F.greatest("child", "parent").alias("hi"), F.when(F.col("child") < F.col("parent"), 1).otherwise(2).alias("bit"))
    had = had.distinct().groupBy("lo", "hi").agg(F.sum("bit").cast("int").alias("had"))
    totals = each.groupBy("lo", "hi", "_r").agg(F.max_by("after", "_i").alias("f")).join(had, ["lo", "hi"], "left").withColumn("had", F.coalesce("had", F.lit(0)))
    step = lambda s, f: F.call_function("shiftright", f, s * 2).bitwiseAND(F.lit(3))
    earlier = F.collect_list("f").over(Window.partitionBy("lo", "hi").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))  # one for each range
    starts = cut(totals.withColumn("start", F.aggregate(earlier, F.col("had"), step)).withColumn("end", step(F.col("start"), F.col("f"))))
    at = each.join(starts.select("lo", "hi", "_r", "start"), ["lo", "hi", "_r"]).withColumn("state", step(F.col("start"), F.col("before")))
    own = F.when(F.col("code") % 2 == 0, 1).otherwise(2)
    has = F.col("state").bitwiseAND(own) > 0
    status = F.when(F.col("code") < 2, F.when(has, "exists").when(F.col("state") > 0, "mutual").otherwise("ok")).otherwise(F.when(has, "ok").otherwise("missing"))
    answers = at.select("seq", status.alias("status")).unionByName(got.where("bad is not null").select("seq", F.col("bad").alias("status")))
    ends = starts.groupBy("lo", "hi").agg(F.max_by("end", "_r").alias("end"))
    pairs = links.select("child", "parent", F.least("child", "parent").alias("lo"), F.greatest("child", "parent").alias("hi")).distinct()
    made = ends.select(F.explode(F.array(F.struct(F.col("lo").alias("child"), F.col("hi").alias("parent"), F.lit(1).alias("bit")), F.struct(F.col("hi").alias("child"), F.col("lo").alias("parent"), F.lit(2).alias("bit")))).alias("x"), "end").where(F.col("end").bitwiseAND(F.col("x.bit")) > 0)
    return answers, pairs.join(ends, ["lo", "hi"], "left_anti").select("child", "parent").unionByName(made.select("x.child", "x.parent"))


def degrees(states: DataFrame, current: DataFrame, edges: DataFrame) -> DataFrame:
    """states with in_count and out_count over edges(from_id, to_id), one row an edge, and is_current. States with no incoming
    edge are the orphans; those without any edge the certain ones. Counts are taken before the join, so a state that a
    third of all edges lead to is one row."""
    ins = edges.groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("in_count"))
    outs = edges.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("out_count"))
    now = current.select("id", F.lit(True).alias("now")).distinct()
    got = states.join(ins, "id", "left").join(outs, "id", "left").join(now, "id", "left")
    return got.select(states.columns + [F.coalesce(c, F.lit(0)).alias(c) for c in ("in_count", "out_count")] + [F.coalesce("now", F.lit(False)).alias("is_current")])


def orphans(states: DataFrame, current: DataFrame, edges: DataFrame) -> DataFrame:
    """``degrees`` of the states that nothing leads to. What is led to goes first, so only the rest meets its own edges."""
    led = edges.select(F.col("to_id").alias("id")).distinct()
    left = table(states.join(led, "id", "left_anti"), "orphans")
    outs = edges.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("out_count"))
    now = current.join(left.select("id"), "id", "left_semi").select("id", F.lit(True).alias("now")).distinct()
    got = left.join(outs, "id", "left").join(now, "id", "left")
    return got.select(*states.columns, F.lit(0).cast("long").alias("in_count"), F.coalesce("out_count", F.lit(0)).alias("out_count"), F.coalesce("now", F.lit(False)).alias("is_current"))
