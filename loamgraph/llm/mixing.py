"""Mixing sources to target weights by capped water-filling, and seeded whole and fractional repetitions.

``plan`` fills the sources' shares: every source may give at most ``max_epochs`` times its words; what a capped
source cannot take is dealt again to the others by weight until no share is above its cap. Sources are ordered
by ``cap / weight``: the filled prefix is the capped set, and one running sum finds the water level.

``mix`` turns a source's target into repetitions: each document is taken ``whole`` times, and documents in the
order of a seeded hash once more until the source's remaining words are reached. The hash is of the id; the second
and later rows of an id in a source, in the order of their texts' hashes, add their number. The cut is found on hash
buckets first (one row per source and bucket) and then inside the one bucket that holds it, so a source with a
third of all rows is never sorted in one task; the result is one key per source.

Defined results: null or blank texts have size 0 and are taken 0 words; an unknown source is a source of its
own (null, last); an empty table gives an empty result; rows that repeat an id, a null one too, have places of their
own in the order, so each source comes within one document of its target; extra columns are not looked at by ``mix``
and kept by ``mixed``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, prefixed, table, written

WEIGHTS = (3, 1, 2)
SEED = "mix-1"
BUCKETS = 4096
#: Sources whose targets are sent to every task; more are joined by a shuffle.
SOURCES = 10_000


def plan(sizes: DataFrame, weights=WEIGHTS, share_num: int = 3, share_den: int = 2, max_epochs: int = 2) -> DataFrame:
    """Per source of ``sizes(source, source_size)``: weight and target words, which sum to share_num / share_den of all
    words unless every source is capped. Ranks and running sums go over ranges of sources, however many there are."""
    place = [F.col("source").isNull(), F.col("source").cast("binary")]
    pick = F.array(*[F.lit(w) for w in weights])
    few = sizes.limit(SOURCES + 1).count() <= SOURCES

    def before(df: DataFrame, order: list, sums: dict[str, str]) -> DataFrame:
        """``prefixed``; up to ``SOURCES`` rows of a few numbers are ordered in one task."""
        over = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({k: F.coalesce(F.sum(F.expr(v)).over(over), F.lit(0)) for k, v in sums.items()}) if few else prefixed(df, order, sums)

    s = before(sizes, place, {"rank": "1"}).withColumn("weight", F.element_at(pick, (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    s = before(s.drop("rank"), [F.col("source_size") / F.col("weight"), *place], {"filled": f"{max_epochs} * source_size", "passed": "weight"})
    totals = s.agg(F.sum("source_size").alias("all_words"), F.sum("weight").alias("all_weight"))  # one row
    cap = F.col("source_size") * max_epochs
    s = s.join(F.broadcast(totals)).select(
        "source", "source_size", "weight", (share_num * F.col("all_words") - share_den * F.col("filled")).alias("left_num"), (F.col("all_weight") - F.col("passed")).alias("left_weight")
    )
    # capped while the share at this level would be above the cap; the first source that is not sets the level
    free = ~(F.col("weight") * F.col("left_num") > cap * share_den * F.col("left_weight"))
    level = s.where(free).agg(F.max(F.struct("left_weight", "left_num")).alias("level"))  # one row
    s = s.withColumn("capped", ~free).drop("left_num", "left_weight").join(F.broadcast(level))
    target = F.when(F.col("capped"), cap.cast("double")).otherwise((F.col("weight") * F.col("level.left_num")).cast("double") / (F.col("level.left_weight") * share_den).cast("double"))
    return s.select("source", "source_size", "weight", target.alias("target"))


def order_key(seed: str, doc_id, j):
    """The seeded hash of an id; the second and later rows of an id in a source add their number."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), F.when(j > 0, j.cast("string"))))


def bucket_of(k):
    return (F.conv(F.substring(k, 1, 8), 16, 10).cast("long") % BUCKETS).cast("int")


def slim(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) and t, a hash of the text, of every row."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), F.md5("text").alias("t"))


def keyed(rows: DataFrame, seed: str) -> DataFrame:
    """Every row of ``slim`` with its key k, as tables in the shared folder. A row whose id occurs once in its source has
    its key from the id. Rows that repeat an id are numbered in the order of their texts' hashes, over ranges, so a third of
    all rows may have the same id, or none, and the same text."""
    named = written(rows.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.min("t").alias("t"), F.min("size").alias("size")), "ids")
    single = named.where("n = 1").select("source", "doc_id", "t", "size", F.lit(0).cast("long").alias("j"))
    again = named.where("n > 1").select(F.col("source").alias("_s"), F.col("doc_id").alias("_d"))
    if not again.isEmpty():
        same = F.col("source").eqNullSafe(F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_d"))
        single = single.unionByName(written(numbered(rows.join(again, same, "left_semi")), "mix"))
    return single.withColumn("k", order_key(seed, F.col("doc_id"), F.col("j")))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows of ``slim`` that repeat an id, with their number j in the order of their texts' hashes."""
    distinct = rows.groupBy("source", "doc_id", F.col("t").isNull().alias("nt"), "t", "size").agg(F.count("*").alias("n"))
    at = prefixed(distinct, ["source", "doc_id", "nt", "t"], {"j0": "n"}, ("source", "doc_id"))
    block = 256  # copies that one row stands for until they are dealt
    at = at.select("source", "doc_id", "t", "size", "j0", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / block))).alias("part"))
    at = at.repartition("source", "doc_id", "t", "part")
    j = F.explode(F.sequence(F.col("j0") + F.col("part") * block, F.col("j0") + F.least(F.col("n"), (F.col("part") + 1) * block) - 1))
    return at.select("source", "doc_id", "t", "size", j.alias("j"))


def cuts(rows: DataFrame, weights=WEIGHTS, max_epochs: int = 2, share: tuple[int, int] = (3, 2)) -> DataFrame:
    """Per source of rows(source, size, k): source_size, target, whole, and cut, the last key in the order (bucket, key)
    that is taken once more (null: none)."""
    rows = rows.withColumn("bucket", bucket_of("k"))
    parts = written(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "buckets")
    goals = (
        plan(written(parts.groupBy("source").agg(F.sum("words").alias("source_size")), "sizes"), weights, *share, max_epochs)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(F.lit(0)).cast("long"))
        .withColumn("more", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
        .withColumnRenamed("source", "g")
    )
    goals = written(goals, "goals")
    run = Window.partitionBy("source").orderBy("bucket")  # at most BUCKETS rows of a source
    at = parts.withColumn("upto", F.sum("words").over(run)).join(goals, F.col("source").eqNullSafe(F.col("g"))).drop("g")
    at = written(at.withColumn("start", F.col("upto") - F.col("words")).select("source", "bucket", "start", "upto", "more"), "at")
    # the one bucket of each source that holds the cut: a few rows, as keys are hashes
    inside = at.where("upto > more and start < more").select(F.col("source").alias("s"), F.col("bucket").alias("b"), "start", "more")
    held = rows.join(inside, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    done = F.col("start") + F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("k").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    last = held.withColumn("done", done).where(F.col("done") - F.col("size") / 2 <= F.col("more")).groupBy("source").agg(F.max(F.struct("bucket", "k")).alias("cut"))
    whole = at.where("more > 0 and upto <= more").groupBy("source").agg(F.max("bucket").alias("bucket")).select("source", F.struct("bucket", F.lit("~").alias("k")).alias("cut"))
    cut = last.unionByName(whole).groupBy(F.col("source").alias("s")).agg(F.max("cut").alias("cut"))
    return written(goals.join(cut, F.col("g").eqNullSafe(F.col("s")), "left").drop("s"), "cuts")


def with_cuts(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """Adds the columns of ``cuts`` and repeats to rows(source, k). Few sources are sent to every task, up to ``SOURCES``
    rows of five values; beyond that rows and sources are shuffled."""
    small = cut.limit(SOURCES + 1).count() <= SOURCES
    both = rows.join(F.broadcast(cut) if small else cut.hint("merge"), F.col("source").eqNullSafe(F.col("g"))).drop("g")
    extra = F.coalesce(F.struct(bucket_of("k").alias("bucket"), F.col("k")) <= F.col("cut"), F.lit(False)).cast("long")
    return both.withColumn("repeats", F.col("whole") + extra).drop("cut", "whole", "more")


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = 2, seed: str = SEED, share: tuple[int, int] = (3, 2)) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, repeats and taken."""
    rows = keyed(slim(docs), seed)
    out = with_cuts(rows, cuts(rows, weights, max_epochs, share))
    return out.select("doc_id", "source", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


def op7_mixing(spark, sf_dir) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '{WORD}')) END AS size,
                  row_number() OVER (PARTITION BY source, doc_id ORDER BY text IS NULL, md5(text)) - 1 AS j FROM documents),
e AS (SELECT doc_id, source, size, md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || CASE WHEN j = 0 THEN '' ELSE '|' || j END) AS k FROM d),
b AS (SELECT *, CAST(('0x' || substr(k, 1, 8)) AS BIGINT) % {BUCKETS} AS bucket FROM e),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS n FROM d GROUP BY source),
w AS (SELECT *, CASE n % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
l AS (SELECT *, 3 * sum(source_size) OVER () - 2 * coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ln,
             sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lw
      FROM w WINDOW o AS (ORDER BY source_size / weight, source IS NULL, encode(source))),
f AS (SELECT *, weight * ln > 4 * source_size * lw AS capped FROM l),
lev AS (SELECT ln, lw FROM f WHERE NOT capped ORDER BY lw DESC LIMIT 1),
t AS (SELECT f.source, f.source_size, CASE WHEN f.capped THEN CAST(2 * f.source_size AS DOUBLE) ELSE CAST(f.weight * lev.ln AS DOUBLE) / CAST(lev.lw * 2 AS DOUBLE) END AS target
      FROM f LEFT JOIN lev ON true),
g AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END AS whole FROM t),
c AS (SELECT b.doc_id, b.size, g.source_size, g.target, g.whole, greatest(g.target - g.whole * g.source_size, 0) AS more,
             sum(b.size) OVER (PARTITION BY b.source ORDER BY b.bucket, b.k) AS done,
             sum(b.size) OVER (PARTITION BY b.source ORDER BY b.bucket) AS upto
      FROM b JOIN g ON b.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (whole + CASE WHEN more <= 0 THEN 0 WHEN upto <= more THEN 1 WHEN done - size / 2 <= more THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c
"""


#: How times are written out for a row's hash: to the microsecond.
EXACT = {"timestampFormat": "G yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "G yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def mixed(docs: DataFrame, weights=WEIGHTS, max_epochs: int = 2, seed: str = SEED, share: tuple[int, int] = (3, 2)) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, all columns as they are. Columns of docs may have any names.

    A row whose id occurs once in its source has its key from its id, so its text is read where it lies and never
    shuffled. Rows that repeat an id are told apart by a hash of all their columns; rows equal in all are one row with
    the sum of what their copies take, dealt over tasks in blocks.
    """
    rows = keyed(slim(docs), seed)
    cut = cuts(rows, weights, max_epochs, share)
    again = written(rows.where("j > 0").select(F.col("source").alias("_s"), F.col("doc_id").alias("_d")).distinct(), "repeated")
    body = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    single = docs.select(F.col("source").alias("_source"), F.col("doc_id").alias("_doc"), body)
    same = F.col("_source").eqNullSafe(F.col("_s")) & F.col("_doc").eqNullSafe(F.col("_d"))
    take = lambda df: with_cuts(df.withColumnRenamed("_source", "source"), cut).where("repeats > 0")
    out = []
    if not again.isEmpty():
        many = single.join(again, same, "left_semi").withColumn("_t", F.md5("row.text")).withColumn("_h", F.md5(F.to_json("row", EXACT)))
        kinds = written(many.groupBy("_source", "_doc", "_t", "_h").agg(F.first("row").alias("row"), F.count("*").alias("n")), "kinds")
        # the copies of one text are dealt to its rows in the order of their hashes
        at = prefixed(kinds.drop("row"), ["_source", "_doc", F.col("_t").isNull(), "_t", "_h"], {"j0": "n"}, ("_source", "_doc"))
        each = at.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 256)))).repartition("_h", "part")
        each = each.withColumn("j", F.explode(F.sequence(F.col("j0") + F.col("part") * 256, F.col("j0") + F.least(F.col("n"), (F.col("part") + 1) * 256) - 1)))
        each = take(each.withColumn("k", order_key(seed, F.col("_doc"), F.col("j"))))
        each = written(each.groupBy("_h", "part").agg(F.sum("repeats").alias("repeats")), "each")
        out.append(kinds.select("_h", "row").join(each, "_h").select("row", "repeats"))
        single = single.join(again, same, "left_anti")
    out.append(take(single.withColumn("k", order_key(seed, F.col("_doc"), F.lit(0)))).select("row", "repeats"))
    found = out[0] if len(out) == 1 else out[0].unionByName(out[1])
    return found.select("row", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))).select("row.*")
