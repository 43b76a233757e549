"""Row-level change capture: overwrite semantics, net-zero filtering, review groups, rollback and the revision tree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .steps import cut, table

#: The tables from the most to the least telling one.
RANK = {"nodes": 5, "memories": 4, "edges": 3, "paths": 2, "glossary_keywords": 1}


def recorded(writes: DataFrame) -> DataFrame:
    """One row per key of writes(tbl, pk, seq, before, after, node_uuid): the first before and the last after."""
    key = F.concat(F.col("tbl"), F.lit(":"), F.col("pk")).alias("row_key")
    first, last = F.min(F.struct("seq", "before"))["before"], F.max(F.struct("seq", "after"))["after"]
    return writes.groupBy(key, "tbl", "node_uuid").agg(first.alias("before"), last.alias("after"), F.count("*").alias("writes"))


def changed(rows: DataFrame) -> DataFrame:
    """Rows whose images differ; created and deleted again counts as nothing."""
    return rows.where(~F.col("before").eqNullSafe(F.col("after")))


def groups(rows: DataFrame) -> DataFrame:
    """Per node: the most telling table, what happened to it, and how many rows changed."""
    rank = F.coalesce(*[F.when(F.col("tbl") == t, F.lit(r)) for t, r in RANK.items()], F.lit(0))
    top = rows.withColumn("rank", rank)
    top = top.withColumn("best", F.max("rank").over(Window.partitionBy("node_uuid")))
    on = F.col("rank") == F.col("best")
    made, gone = F.bool_and(F.when(on, F.col("before").isNull())), F.bool_and(F.when(on, F.col("after").isNull()))
    return top.groupBy("node_uuid").agg(F.max(F.when(on, F.col("tbl"))).alias("top_table"), F.when(made, "created").when(gone, "deleted").otherwise("modified").alias("action"), F.count("*").alias("row_count"))


def reverted(state: DataFrame, rows: DataFrame) -> DataFrame:
    """state(row_key, image) with the before-images of rows laid over it."""
    keep = state.join(rows.select("row_key"), "row_key", "left_anti")
    return keep.unionByName(rows.where("before is not null").select("row_key", F.col("before").alias("image")))


def ancestors(revisions: DataFrame, start: DataFrame) -> DataFrame:
    """(origin, id, depth) of start(origin) and every revision above it, however many: log2(depth) rounds, each of which
    adds what lies 2^k links above all that is known. Each revision comes once, so a cycle of parents ends."""
    up = cut(revisions.where("parent_id is not null").select(F.col("id").alias("at"), F.col("parent_id").alias("above")))
    out = cut(start.select("origin", F.col("origin").alias("id"), F.lit(0).alias("depth")).distinct())
    step = 1
    while True:
        more = out.join(up, F.col("id") == F.col("at")).select("origin", F.col("above").alias("id"), (F.col("depth") + step).alias("depth"))
        more = cut(more.groupBy("origin", "id").agg(F.min("depth").alias("depth")).join(out, ["origin", "id"], "left_anti"))
        if more.isEmpty():
            return out
        out = cut(out.unionAll(more))
        far = up.select(F.col("at").alias("above"), F.col("above").alias("above2"))
        up, step = cut(up.join(far, "above").select("at", F.col("above2").alias("above"))), 2 * step


#: How many ancestors a row holds at most.
BLOCK = 256


def lineages(revisions: DataFrame) -> DataFrame:
    """(origin, id, depth) of every one of revisions(id, parent_id), whose ids are unique, and all known ones above it, as
    ``ancestors`` tells it.

    Only revisions with four generations below them get their ancestors as an array, by doubling; in most trees these are
    few. The others go up to them step by step, and the rows are made where that is read, so none is sent or written. If a way
    is longer than BLOCK above those, or a ring, the ancestors are listed instead."""
    known = revisions.select(F.col("id").alias("up"), F.lit(True).alias("there"))
    base = table(revisions.select("id", F.col("parent_id").alias("up")).join(known, "up", "left").select("id", F.when(F.col("there"), F.col("up")).alias("up")), "revisions")
    levels = [base]
    for _ in range(4):
        above = levels[-1].where("up is not null").select(F.col("up").alias("id")).distinct()
        levels.append(table(levels[-1].join(above, "id", "left_semi"), "above"))
    rows, size = table(levels.pop().select("id", F.array("id").alias("ids"), F.col("up").alias("to")), "block"), 1
    while not rows.where("to is not null").isEmpty():
        if size >= BLOCK:
            return ancestors(base.withColumnRenamed("up", "parent_id"), base.select(F.col("id").alias("origin")))
        far = rows.select(F.col("id").alias("to"), F.col("ids").alias("more"), F.col("to").alias("far"))
        more = rows.where("to is not null").join(far, "to").select("id", F.concat("ids", "more").alias("ids"), F.col("far").alias("to"))
        rows, size = table(rows.where("to is null").unionByName(more), "block"), 2 * size
    ways = base.select(F.array("id").alias("own"), F.col("up").alias("to"))
    for level in levels[1:]:
        step = level.select(F.col("id").alias("to"), F.col("up").alias("far"))
        ways = ways.join(step, "to", "left").select(F.when(F.col("to").isNull(), F.col("own")).otherwise(F.concat("own", F.array("to"))).alias("own"), F.col("far").alias("to"))
    ways = ways.join(rows.select(F.col("id").alias("to"), "ids"), "to", "left")
    every = F.when(F.col("ids").isNull(), F.col("own")).otherwise(F.concat("own", "ids"))
    return ways.select(F.element_at("own", 1).alias("origin"), F.posexplode(every).alias("depth", "id")).select("origin", "id", "depth")


def nearest(revisions: DataFrame, key: Column) -> DataFrame:
    """(origin, key, nearest_target, nearest_head): of the revisions at and above each one, by a ``key`` that is never null,
    the furthest and the closest. A row a revision, with both ids for each key among the 2^k ones from it up, so the ancestors
    themselves are never listed but where parents form a ring."""
    own = F.create_map(key, F.col("id"))
    open_, done, step = table(revisions.select("id", F.col("parent_id").alias("to"), own.alias("heads"), own.alias("targets")), "above"), [], 1
    none = F.map_filter("heads", lambda k, v: F.lit(False))
    while True:
        done.append(open_.where("to is null"))
        open_ = open_.where("to is not null")
        left = open_.count()
        if not left or step > left + sum(d.count() for d in done):
            break
        every = reduce(DataFrame.unionAll, [*done, open_])
        # what is pointed at gets less with each step, and is sent to all tasks then, however many point at one
        up = table(every.join(open_.select(F.col("to").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("heads").alias("h"), F.col("targets").alias("t")), "up")
        got = open_.join(up, "to", "left").withColumns({"h": F.coalesce("h", none), "t": F.coalesce("t", none)})
        heads = F.map_concat("heads", F.map_filter("h", lambda k, v: ~F.map_contains_key("heads", k)))
        targets = F.map_concat(F.map_filter("targets", lambda k, v: ~F.map_contains_key("t", k)), "t")
        open_, step = table(got.select("id", F.col("far").alias("to"), heads.alias("heads"), targets.alias("targets")), "above"), 2 * step
    out = reduce(DataFrame.unionAll, done).select(F.col("id").alias("origin"), F.explode("heads").alias("key", "nearest_head"), "targets")
    out = out.select("origin", "key", F.element_at("targets", F.col("key")).alias("nearest_target"), "nearest_head")
    if not left:
        return out
    rings = ancestors(revisions, open_.select(F.col("id").alias("origin"))).join(revisions.select("id"), "id", "left_semi").withColumn("key", key)
    return out.unionByName(rings.groupBy("origin", "key").agg(F.max_by("id", "depth").alias("nearest_target"), F.min_by("id", "depth").alias("nearest_head")))
