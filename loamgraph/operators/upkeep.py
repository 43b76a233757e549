"""Upkeep in batches: stepwise migrations, frozen revisions, presets and their start lists, topics, start pages, draws."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import mutations as M
from .reads import first_by

Tables = dict[str, DataFrame]


def migrate(tables: Tables, applied: set[str], steps: dict[str, Callable[[Tables], Tables]]) -> tuple[Tables, list[str]]:
    """Runs the steps whose names are not in applied, in the order of their names, each on what the last one left; returns
    the tables and the names to record. Nothing is read before the tables are used."""
    due = [name for name in sorted(steps) if name not in applied]
    for name in due:
        tables = tables | steps[name](tables)
    return tables, due


def retire_orphans(tables: Tables) -> Tables:
    """Active versions of nodes that no path leads to are retired."""
    reached = tables["paths"].select("node_uuid").distinct().withColumn("reached", F.lit(True))
    m = tables["memories"].join(reached, "node_uuid", "left")
    return {"memories": m.withColumn("deprecated", F.col("deprecated") | F.col("reached").isNull()).drop("reached")}


def keep_newest(tables: Tables) -> Tables:
    """Of a node's active versions the newest stays; the others are retired towards it."""
    o = Window.partitionBy("node_uuid", "deprecated").orderBy(F.col("created_at").desc(), F.col("id").desc())
    old = ~F.col("deprecated") & (F.row_number().over(o) > 1)
    m = tables["memories"].withColumn("old", old).withColumn("first", F.first("id").over(o))
    return {"memories": m.withColumn("migrated_to", F.when(F.col("old"), F.coalesce("migrated_to", "first")).otherwise(F.col("migrated_to"))).withColumn("deprecated", F.col("deprecated") | F.col("old")).drop("old", "first")}


def fill_path_nodes(tables: Tables) -> Tables:
    """Paths without a node take their edge's child."""
    e = tables["edges"].select(F.col("id").alias("edge_id"), F.col("child_uuid").alias("child"))
    p = tables["paths"].join(e, "edge_id", "left")
    return {"paths": p.withColumn("node_uuid", F.coalesce("node_uuid", "child")).drop("child")}


#: The steps that change rows; those that only add columns are the readers' schemas.
STEPS = {"006_retire_orphans": retire_orphans, "007_keep_newest": keep_newest, "013_fill_path_nodes": fill_path_nodes}


def commit(revisions: DataFrame, rows: DataFrame) -> DataFrame:
    """Freezes rows(namespace, row_key, before, after): one new revision a namespace, whose parent is the newest one there.
    One line a row, (revision_id, parent_id, namespace, row_key, json), so a change set of any size stays spread."""
    heads = revisions.groupBy("namespace").agg(F.max("id").alias("parent_id"))
    fresh = rows.select("namespace").distinct().join(heads, "namespace", "left")
    made = M.numbered(fresh, revisions, "id", "namespace").withColumnRenamed("id", "revision_id")
    image = F.to_json(F.struct("before", "after"), {"ignoreNullFields": "false"})
    return rows.join(made, "namespace").select("revision_id", "parent_id", "namespace", "row_key", image.alias("json"))


def expired(logs: DataFrame, keep_days: int | None, as_of: Column) -> DataFrame:
    """Log rows that retention deletes: those older than keep_days, or all without a positive number of days."""
    if not keep_days or keep_days < 0:
        return logs
    return logs.where(F.col("accessed_at") < as_of - F.make_dt_interval(F.lit(keep_days)))


def preset_requests(presets: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(seq, op, id, name) with a status: ok, unknown (no such preset), active (an active one is not deleted) or
    taken (another preset has the name, or a request before this one gets it)."""
    there = presets.select("id", F.lit(True).alias("there"), "is_active", F.col("name").alias("old_name"))
    owner = presets.select("name", F.col("id").alias("owner"))
    got = requests.join(there, "id", "left").join(owner, "name", "left")
    naming = F.col("op").isin("create", "duplicate", "update")
    foreign = F.col("owner").isNotNull() & ((F.col("op") != "update") | (F.col("owner") != F.col("id")))
    early = F.when((F.col("op") != "create") & F.col("there").isNull(), "unknown").when((F.col("op") == "delete") & F.col("is_active"), "active").when(naming & foreign, "taken")
    got = got.withColumn("early", early)
    first = F.row_number().over(Window.partitionBy("name", naming & F.col("early").isNull()).orderBy("seq")) == 1
    return got.withColumn("status", F.coalesce("early", F.when(naming & ~first, "taken").otherwise("ok"))).select("seq", "op", "id", "name", "status")


def presets_after(presets: DataFrame, answered: DataFrame) -> DataFrame:
    """The presets once the requests that are ok are carried out: updates rename, deletions go, a duplicate copies the list
    and is inactive, a new one has an empty list. New ids follow the largest one in the order of the requests."""
    ok = answered.where("status = 'ok'")
    gone = ok.where("op = 'delete'").select("id")
    named = first_by(ok.where("op = 'update'"), ["id"], F.col("seq").desc()).select("id", F.col("name").alias("new_name"))
    kept = presets.join(gone, "id", "left_anti").join(named, "id", "left").select("id", F.coalesce("new_name", "name").alias("name"), "boot_uris", "is_active")
    lists = presets.select("id", "boot_uris")
    fresh = ok.where("op in ('create', 'duplicate')").join(lists, "id", "left")
    copied = F.when(F.col("op") == "duplicate", F.col("boot_uris")).otherwise(F.lit("{}"))
    new = M.numbered(fresh.select("seq", "name", copied.alias("boot_uris")), presets, "id", "seq")
    return kept.unionByName(new.select("id", "name", "boot_uris", F.lit(False).alias("is_active")))


def rewritten(uris: Column, old: Column, new: Column) -> Column:
    """A list of addresses after ``old`` and everything below it moved to ``new``."""
    below = F.concat(old, F.lit("/"))
    return F.transform(uris, lambda u: F.when(u == old, new).when(F.startswith(u, below), F.concat(new, F.lit("/"), F.substr(u, F.length(below) + 1))).otherwise(u))


def purged(uris: Column, gone: Column) -> Column:
    """A list of addresses without ``gone`` and everything below it."""
    return F.filter(uris, lambda u: (u != gone) & ~F.startswith(u, F.concat(gone, F.lit("/"))))


def boot_set(lists: Column, namespace: Column, uris: Column) -> Column:
    """A map of lists with one namespace's list replaced, or taken out where uris is null."""
    rest = F.map_filter(lists, lambda k, _: k != namespace)
    return F.when(uris.isNull(), rest).otherwise(F.map_concat(rest, F.create_map(namespace, uris)))


def organise(paths: DataFrame, edges: DataFrame, memories: DataFrame, requests: DataFrame) -> DataFrame:
    """Gathers sources below topics: requests(seq, topic_domain, topic_path, namespace, domain, path, importance, note,
    mode), one row a source.

    A topic is made once, under the path above it. Each source gets a path below its topic under its own last segment, at
    the next lower importance and with the topic's note or a default one. Statuses: ok, no topic (it cannot be made),
    missing, cycle (the topic would lie below its source) or taken; the others go on. With mode ``move`` the old path of
    each source that is ok goes.
    """
    parent = F.when(F.col("topic_path").contains("/"), F.regexp_replace("topic_path", "/[^/]*$", "")).otherwise(F.lit(""))
    asked = first_by(requests, ["namespace", "topic_domain", "topic_path"], "seq")
    plan = asked.select("seq", "namespace", F.col("topic_domain").alias("domain"), parent.alias("parent_path"), T.last_segment(F.col("topic_path")).alias("title"), F.lit("").alias("content"), F.col("importance").alias("priority"))
    topics = M.create(paths, edges, memories, plan).select("namespace", F.col("domain").alias("topic_domain"), F.col("path").alias("topic_path"), "parent_uuid", F.col("status").alias("made"))
    at = paths.select("namespace", "domain", "path", "node_uuid")
    got = requests.join(topics, ["namespace", "topic_domain", "topic_path"], "left").join(at, ["namespace", "domain", "path"], "left")
    pairs = got.where("made = 'ok' and node_uuid is not null").select("parent_uuid", F.col("node_uuid").alias("child_uuid")).distinct()
    ring = M.would_cycle(edges, pairs).select("parent_uuid", F.col("child_uuid").alias("node_uuid"), "cycle")
    got = got.join(ring, ["parent_uuid", "node_uuid"], "left").withColumn("new_path", F.concat("topic_path", F.lit("/"), T.last_segment(F.col("path"))))
    used = paths.select("namespace", F.col("domain").alias("topic_domain"), F.col("path").alias("new_path"), F.lit(True).alias("used"))
    early = F.when(F.coalesce("made", F.lit("")) != "ok", "no topic").when(F.col("node_uuid").isNull(), "missing").when(F.col("cycle"), "cycle").when(F.col("used"), "taken")
    got = got.join(used, ["namespace", "topic_domain", "new_path"], "left").withColumn("early", early)
    first = F.row_number().over(Window.partitionBy("namespace", "topic_domain", "new_path", F.col("early").isNull()).orderBy("seq")) == 1
    got = got.withColumn("status", F.coalesce("early", F.when(first, "ok").otherwise("taken")))
    note = F.coalesce(F.nullif("note", F.lit("")), F.concat(F.lit("当说起"), T.last_segment(F.col("path")), F.lit("时")))
    ok = F.col("status") == "ok"
    return got.select("seq", "namespace", "topic_domain", "topic_path", "domain", "path", F.when(ok, F.col("new_path")).alias("new_path"), F.when(ok, F.col("importance") + 1).alias("priority"), F.when(ok, note).alias("disclosure"), "status", (ok & (F.col("mode") == "move")).alias("moved"))


def wakeup(star: DataFrame, boot: DataFrame, parts: list[tuple[str, str, int]], namespace: str = "") -> DataFrame:
    """A start page's entries (section, k, uri, memory_id): boot(k, uri) in its order where there is a memory, then for each
    (section, domain, n) of parts the n newest nodes of the domain, without those that are on the boot list."""
    here = star.where(F.col("namespace") == namespace).withColumn("uri", T.uri_of(F.col("domain"), F.col("path")))
    out = boot.join(here.select("uri", "memory_id"), "uri").select(F.lit("boot").alias("section"), F.col("k").cast("int").alias("k"), "uri", "memory_id")
    for section, domain, n in parts:
        new = first_by(here.where(F.col("domain") == domain), ["node_uuid"], "path").orderBy(F.col("m_created").desc(), "node_uuid").limit(n)
        k = F.row_number().over(Window.orderBy(F.col("m_created").desc(), "node_uuid"))  # n rows
        out = out.unionByName(new.withColumn("k", k).join(boot.select("uri"), "uri", "left_anti").select(F.lit(section).alias("section"), "k", "uri", "memory_id"))
    return out


def chance(seed: str, key: Column) -> Column:
    """A number in (0, 1) that depends on the seed and the key alone, so reruns and retried tasks agree."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, 8), 16, 10).cast("long") + 0.5) / 4294967296.0


def draw(weights: DataFrame, places: DataFrame, seed: str, by: str) -> DataFrame:
    """One node of weights(by, node_uuid, weight) for each value of ``by``, with a chance in proportion to its weight, and
    one of its places(by, node_uuid, uri): the smallest -ln(u) / weight wins, which partial aggregation finds."""
    key = -F.log(chance(seed, F.col("node_uuid"))) / F.col("weight")
    won = weights.where("weight > 0").groupBy(by).agg(F.min_by("node_uuid", F.struct(key, "node_uuid")).alias("node_uuid"))
    return won.join(places, [by, "node_uuid"]).groupBy(by, "node_uuid").agg(F.min_by("uri", F.struct(chance(seed, F.col("uri")), "uri")).alias("uri"))


def tags_after(tags: Column, add: Column, remove: Column) -> Column:
    """Tags in order without those removed, then the new ones; null where a tag is to be both added and removed."""
    new = F.array_except(F.array_distinct(F.transform(add, lambda x: F.trim(x))), F.array(F.lit("")))
    return F.when(F.size(F.array_intersect(add, remove)) == 0, F.array_distinct(F.concat(F.array_except(tags, remove), new)))


def line_edit(content: Column, op: Column, line: Column, text: Column) -> Column:
    """append (after a blank line), set, delete or insert after a line (from 1); a line out of range changes nothing."""
    parts = F.split(content, "\n")
    n, cut_at = F.size(parts), lambda a, b: F.slice(parts, a, b)
    rest = lambda k: F.when(k <= n, cut_at(k, F.greatest(n - k + 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    inside = (line >= 1) & (line <= n)
    put = lambda left, mid, right: F.array_join(F.concat(cut_at(F.lit(1), left), mid, rest(right)), "\n")
    none = F.array().cast("array<string>")
    return (
        F.when(op == "append", F.concat(F.regexp_replace(content, r"\s+$", ""), F.lit("\n\n"), text))
        .when((op == "set") & inside, put(line - 1, F.array(text), line + 1))
        .when((op == "delete") & inside, put(line - 1, none, line + 1))
        .when((op == "insert") & (line >= 0) & (line <= n), put(line, F.array(text), line + 1))
        .otherwise(content)
    )
