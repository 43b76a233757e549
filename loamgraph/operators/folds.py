"""Requests that are taken one after the other: several of one node, each upon what the last has left.

Running counts and last values go over ranges of the order, so the requests of one node may be a third of the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.udfs import nfc
from .mutations import numbered
from .steps import cut, table


#: Of so many rows one marks where a long key may be split.
SPLIT = 50_000


def running(df: DataFrame, keys: list[str], order: list[str], counts: dict[str, str] | None = None, lasts: dict[str, str] | None = None) -> DataFrame:
    """Adds to each row, over the rows of its keys up to and with it in ``order``: for counts = {new: column} how many are
    not null there, for lasts = {new: column} the last that is not null (or null).

    Rows are sent once, by their keys. A key with many rows is split into stretches of its order, at rows that their hashes
    mark; what comes before a stretch is one row for each. Keys must not be null; the order must be total.
    """
    counts, lasts = counts or {}, lasts or {}
    at = F.struct(*order)
    marks = df.where(F.pmod(F.xxhash64(*keys, *order), F.lit(SPLIT)) == 0).groupBy(*keys).agg(F.sort_array(F.collect_list(at)).alias("_marks"))
    marks = cut(marks.where(F.size("_marks") > 1))
    split = not marks.isEmpty()
    dealt = df
    if split:
        dealt = df.join(F.broadcast(marks), keys, "left").withColumn("_part", F.coalesce(F.size(F.filter("_marks", lambda m: m <= at)), F.lit(0)))
    here = Window.partitionBy(*keys, *(["_part"] if split else [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumns({**{n: F.count(c).over(here) for n, c in counts.items()}, **{n: F.last(c, ignorenulls=True).over(here) for n, c in lasts.items()}})
    if not split:
        return own
    put = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(at.alias("o"), F.col(c).alias("v"))))
    sums = dealt.where("_marks is not null").groupBy(*keys, "_part").agg(F.count("*").alias("_n"), *[F.count(c).alias(f"_c{k}") for k, c in enumerate(counts.values())], *[put(c).alias(f"_l{k}") for k, c in enumerate(lasts.values())])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "_part", *[F.sum(f"_c{k}").over(before).alias(f"_c{k}") for k in range(len(counts))], *[F.max(f"_l{k}").over(before)["v"].alias(f"_l{k}") for k in range(len(lasts))])
    out = own.join(F.broadcast(starts), [*keys, "_part"], "left")
    out = out.withColumns({**{n: F.col(n) + F.coalesce(f"_c{k}", F.lit(0)) for k, n in enumerate(counts)}, **{n: F.coalesce(n, f"_l{k}") for k, n in enumerate(lasts)}})
    return out.select(*df.columns, *counts, *lasts)


def met(star: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests with what is at their paths, and a status."""
    found = star.select("namespace", "domain", "path", "edge_id", "node_uuid", "memory_id", F.col("priority").alias("had_priority"), F.col("disclosure").alias("had_disclosure"), F.col("world_timestamp").alias("had_world"))
    none = F.coalesce(F.col("content"), F.col("priority").cast("string"), F.col("disclosure"), F.col("world_timestamp")).isNull()
    got = requests.join(found, ["namespace", "domain", "path"], "left")
    status = F.when(none, "nothing").when(F.col("memory_id").isNull(), "not found").otherwise("ok")
    return got.withColumn("status", status)


def versioned(got: DataFrame, ids: DataFrame, *also: str) -> DataFrame:
    """Of met requests those that are ok, with own_id (of the version that one makes, beyond the largest of ids(id)),
    version, here (the version after it, if the batch has made it), world, and the columns in ``also``."""
    ok = got.where("status = 'ok'").select("seq", "node_uuid", "memory_id", "had_world", "world_timestamp", F.col("content").isNotNull().alias("makes"), *also)
    own = numbered(ok.where("makes").select("seq"), ids.select(F.col("id").alias("own_id")), "own_id", "seq")
    return running(ok.join(own, "seq", "left"), ["node_uuid"], ["seq"], {"version": "own_id"}, {"here": "own_id", "world": "world_timestamp"})


def answers(got: DataFrame, at: DataFrame) -> DataFrame:
    new = F.coalesce("here", "memory_id")
    old = F.lag(new).over(Window.partitionBy("node_uuid").orderBy("seq"))
    out = at.withColumn("new_id", new).withColumn("old_id", F.coalesce(old, "memory_id")).select("seq", F.lit("ok").alias("status"), "node_uuid", "old_id", "new_id")
    return out.unionByName(got.where("status <> 'ok'").select("seq", "status", "node_uuid", F.lit(None).cast("long").alias("old_id"), F.lit(None).cast("long").alias("new_id")))


def versions(at: DataFrame, memories: DataFrame) -> DataFrame:
    """What ``versioned`` requests with their contents make and retire. All that is told of a node's versions is told where
    its requests meet; only the first versions meet the memories."""
    # a version's world time is the last given while it was active, else what the version before had
    new, world = F.coalesce("here", "memory_id"), F.coalesce("world", "had_world")
    own = F.max(F.when(F.col("own_id").isNotNull(), F.struct("own_id", "content")))["content"]
    last = at.repartition("node_uuid").groupBy("node_uuid", "version").agg(F.max(F.struct("seq", new.alias("id"), world.alias("world"), F.col("memory_id"), F.col("had_world"))).alias("x"), own.alias("made"))
    order = Window.partitionBy("node_uuid").orderBy("version")
    # a node whose first request makes a version retires one that no request has touched
    lead = (F.row_number().over(order) == 1) & (F.col("version") > 0)
    row = lambda version, id_, world_, made: F.struct(version.alias("version"), id_.alias("id"), world_.alias("world_timestamp"), made.alias("made"))
    this = row(F.col("version"), F.col("x.id"), F.col("x.world"), F.col("made"))
    zero = row(F.lit(0).cast("long"), F.col("x.memory_id"), F.col("x.had_world"), F.lit(None).cast("string"))
    each = last.select("node_uuid", F.when(lead, F.array(zero, this)).otherwise(F.array(this)).alias("rows")).select("node_uuid", F.inline("rows"))
    each = each.withColumns({"top": F.max("version").over(Window.partitionBy("node_uuid")), "next": F.lead("id").over(order)})
    kept = memories.select("id", "content", F.col("world_timestamp").alias("had"))
    first = each.where("version = 0").join(kept, "id", "left").where((F.col("top") > 0) | ~F.col("world_timestamp").eqNullSafe(F.col("had"))).drop("had", "made")
    rest = each.where("version > 0").withColumn("content", nfc(F.col("made"))).drop("made")
    return first.unionByName(rest).select("id", "node_uuid", "content", (F.col("version") < F.col("top")).alias("deprecated"), F.col("next").alias("migrated_to"), "world_timestamp")


def edges(got: DataFrame) -> DataFrame:
    fold = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("seq", F.col(c).alias("v"))))["v"]
    edge = got.where("status = 'ok'").groupBy("edge_id", "had_priority", "had_disclosure").agg(fold("priority").alias("p"), fold("disclosure").alias("d"))
    edge = edge.select("edge_id", "had_priority", "had_disclosure", F.coalesce("p", "had_priority").alias("priority"), F.coalesce("d", "had_disclosure").alias("disclosure"))
    return edge.where(~F.col("priority").eqNullSafe(F.col("had_priority")) | ~F.col("disclosure").eqNullSafe(F.col("had_disclosure")))


def update(star: DataFrame, memories: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answers, memories, edges) of requests(seq, namespace, domain, path, content, priority, disclosure, world_timestamp),
    taken in the order of seq. A null field is left as it is.

    answers: (seq, status, node_uuid, old_id, new_id): 'nothing' if all fields are null, 'not found' if no active version is
    at the path, else 'ok' with the version before and after. A content makes a version, numbered in the order of the
    batch, to which the one before it moves; it carries the world time on unless the request has one. A world time without
    a content is set on the version that is then active. Priority and disclosure go to the edge of the path. memories and
    edges: the rows as the batch leaves them that are new or other than before; edges with what they had.
    """
    got = table(met(star, requests), "requests")
    at = table(versioned(got, memories, "content"), "versioned")
    return answers(got, at), versions(at, memories), edges(got)
