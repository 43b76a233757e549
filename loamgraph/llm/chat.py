"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

A logger that stores a conversation after every turn leaves snapshots, each a prefix of the next. A turn's
fingerprint depends on its position, role and text; the rolling fingerprint of a prefix combines those of its
turns, so one ordered pass gives every prefix of every conversation. A conversation whose whole fingerprint is a
proper prefix of another one is dropped by an anti-join, equal conversations keep the smallest id, and what
remains (the maximal conversations) is rendered.

Positions come from row order, never from turn numbers: exact repeats are counted as one row, the distinct rows are
dealt by ranges of (conversation, turn, role, text) and sorted there, and counts per range are summed. Blocks are
``BLOCK`` positions: prefixes run inside each block and over the block totals, and text is rendered per block, so a
conversation with a third of all rows is no single task, whatever its turn numbers. Ranges look at the first ``HEAD``
characters of role and text; rows that share these and the turn within one conversation meet in one range.

Defined results: null roles and texts differ from empty ones in the fingerprint and render as empty; rows with a
null conversation form one conversation (null); null turns come first; rows that repeat a turn number are ordered
by role and text, and exact repeats stay; part is the block of positions, floor((pos - 1) / BLOCK), which is
floor(turn / BLOCK) as in the SQL where turns are numbered 0, 1, 2, ...; an empty table gives an empty result; extra
columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

BLOCK, HEAD = 256, 200
OPEN, CLOSE = "<|", "|>"


def ordered(conv: DataFrame) -> DataFrame:
    """conv_id, role, text, n (how often), i (the order over all conversations) and d (a name of role and text) of each
    distinct row."""
    rows = conv.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    head = lambda c: F.substring(c, 1, HEAD)
    dealt = rows.repartitionByRange("conv_id", "turn", head("role"), head("text")).sortWithinPartitions("conv_id", "turn", "role", "text")
    d = F.md5(F.to_json(F.struct(F.col("role").isNull().alias("nr"), "role", F.col("text").isNull().alias("nt"), "text")))
    return written(dealt.select("conv_id", "role", "text", "n", F.monotonically_increasing_id().alias("i"), d.alias("d")), "ordered")


def placed(rows: DataFrame) -> DataFrame:
    """i, conv_id, d, part, first and k: the k equal rows from position ``first`` on that lie in one block."""
    slim = rows.select("conv_id", "i", "n", "d", F.shiftright("i", 33).alias("range"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    counts = slim.groupBy("conv_id", "range").agg(F.sum("n").alias("m"))
    starts = counts.select(F.col("conv_id").alias("c"), F.col("range").alias("r"), F.coalesce(F.sum("m").over(before(Window.partitionBy("conv_id").orderBy("range"))), F.lit(0)).alias("start"))
    inside = slim.withColumn("ahead", F.coalesce(F.sum("n").over(before(Window.partitionBy("conv_id", "range").orderBy("i"))), F.lit(0)))
    at = inside.join(starts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("range") == F.col("r")))
    at = at.select("i", "conv_id", "d", "n", (F.col("start") + F.col("ahead")).alias("s"))
    block = lambda x: F.floor(x / BLOCK)
    at = at.withColumn("part", F.explode(F.sequence(block(F.col("s")), block(F.col("s") + F.col("n") - 1))))
    first, last = F.greatest("s", F.col("part") * BLOCK), F.least(F.col("s") + F.col("n"), (F.col("part") + 1) * BLOCK)
    return written(at.select("i", "conv_id", "d", "part", (first + 1).alias("first"), (last - first).alias("k")), "placed")


def turns(at: DataFrame) -> DataFrame:
    """pos (1, 2, ... in a conversation), part and the two lanes of each prefix's fingerprint."""
    inner = Window.partitionBy("conv_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a row that fills many blocks goes to these first
    each = at.select("conv_id", "part", "first", "k", "d").repartition("conv_id", "part")
    each = each.select("conv_id", "part", "d", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("k") - 1)).alias("pos"))
    one = F.md5(F.concat_ws(":", "pos", "d"))
    lane = lambda i: F.conv(F.substring(one, i, 15), 16, 10).cast("long")
    each = each.withColumn("h1", lane(1)).withColumn("h2", lane(17))
    each = each.withColumn("a", F.bit_xor("h1").over(inner)).withColumn("b", F.bit_xor("h2").over(inner))
    totals = each.groupBy("conv_id", "part").agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
    carried = totals.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.coalesce(F.bit_xor("h1").over(before), F.lit(0)).alias("a0"), F.coalesce(F.bit_xor("h2").over(before), F.lit(0)).alias("b0"))
    both = each.join(carried, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    return both.select("conv_id", "pos", "part", F.col("a").bitwiseXOR(F.col("a0")).alias("fp1"), F.col("b").bitwiseXOR(F.col("b0")).alias("fp2"))


def maximal(conv: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies) of the conversations that no longer one continues; equal ones keep the smallest id."""
    return longest_of(placed(ordered(conv)))


def longest_of(at: DataFrame) -> DataFrame:
    """``maximal`` over placed rows."""
    marks = written(turns(at).select("conv_id", "pos", "fp1", "fp2"), "marks")
    ends = marks.groupBy("conv_id").agg(F.max(F.struct("pos", "fp1", "fp2")).alias("e")).select("conv_id", "e.*")
    whole = ends.groupBy("pos", "fp1", "fp2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    # a prefix is proper in its own conversation if a later turn follows: group first, so that a common opening is one row
    longest = marks.join(ends.select(F.col("conv_id").alias("c"), F.col("pos").alias("n")), F.col("conv_id").eqNullSafe(F.col("c"))).where("pos < n")
    inner = longest.groupBy("pos", "fp1", "fp2").agg(F.count("*").alias("seen"))
    return whole.join(inner, ["pos", "fp1", "fp2"], "left_anti").select("conv_id", F.col("pos").alias("n_turns"), "copies")


def rendered(conv: DataFrame) -> DataFrame:
    """The maximal conversations as marked-up text, one row for each block of turns."""
    rows = ordered(conv)
    at = placed(rows)
    keep = longest_of(at).withColumnRenamed("conv_id", "c")
    line = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit(CLOSE + "\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    body = at.select("i", "conv_id", "part", "first", "k").join(keep, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    body = body.join(rows.select("i", line.alias("line")), "i")
    lines = F.array_sort(F.collect_list(F.struct("first", "k", "line")))
    text = F.array_join(F.transform(lines, lambda t: F.repeat(t["line"], t["k"].cast("int"))), "")
    return body.groupBy("conv_id", "part", "n_turns", "copies").agg(F.sum("k").alias("n_lines"), text.alias("rendered"))


def op5_chat(spark, sf_dir) -> DataFrame:
    return rendered(table(spark, sf_dir, "conversations")).select("conv_id", "part", "n_turns", "copies", "n_lines", "rendered")


ORACLE = f"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos,
                  CAST(floor(coalesce(turn, -1) / {BLOCK}.0) AS BIGINT) AS part FROM conversations),
c AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY pos) AS body, count(*) AS n FROM t GROUP BY conv_id),
e AS (SELECT min(conv_id) AS conv_id, body, max(n) AS n, count(*) AS copies FROM c GROUP BY body),
p AS (SELECT DISTINCT c.body[1:i] AS pre FROM c, generate_series(1, 100000) AS s(i) WHERE s.i < c.n),
m AS (SELECT e.* FROM e WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pre = e.body))
SELECT m.conv_id, t.part, CAST(m.n AS BIGINT) AS n_turns, CAST(m.copies AS BIGINT) AS copies, count(*) AS n_lines,
       string_agg('{OPEN}' || coalesce(t.role, '') || '{CLOSE}' || chr(10) || coalesce(t.text, '') || chr(10), '' ORDER BY t.pos) AS rendered
FROM m JOIN t ON m.conv_id IS NOT DISTINCT FROM t.conv_id GROUP BY ALL
"""
