"""Queries over file formats, by a round trip inside the query."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..registry import query
from ..sources import files as S


@query("i9_markdown", "SELECT domain || '://' || path AS uri, CASE WHEN memory_id % 2 = 0 THEN priority ELSE 5 END AS priority, disclosure, content FROM star WHERE namespace = ''")
def i9(g):
    s = g.star.where("namespace = ''").withColumn("uri", T.uri_of(F.col("domain"), F.col("path")))
    meta = F.when(F.col("memory_id") % 2 == 0, F.concat(F.lit("<!-- priority: "), F.col("priority").cast("string"), F.lit(" -->\n"))).otherwise("")
    note = F.coalesce(F.concat(F.lit("<!-- disclosure: "), "disclosure", F.lit(" -->\n")), F.lit(""))
    pages = max(64, -(-s.count() // 1000))  # about a thousand sections each, however many there are
    page = s.groupBy("domain", F.pmod(F.xxhash64("uri"), F.lit(pages)).alias("page")).agg(F.concat_ws("\n", F.collect_list(F.concat(F.lit("## "), "uri", F.lit("\n"), meta, note, F.lit("\n"), "content", F.lit("\n")))).alias("value"))
    return page.select(F.explode(S.parse_markdown(F.col("value"))).alias("s")).select("s.*")


@query("i10_glossary_json", "SELECT keyword, node_uuid FROM glossary")
def i10(g):
    j = g.glossary.select(F.to_json(F.struct("keyword", "node_uuid")).alias("j"))
    back = j.select(F.from_json("j", "struct<keyword:string,node_uuid:string>").alias("x")).select(F.trim("x.keyword").alias("keyword"), "x.node_uuid")
    return back.where("keyword <> ''").dropDuplicates(["keyword", "node_uuid"])


@query("i12_card_rows", "SELECT 'Card_' || conv_id AS title, section, priority, text AS content FROM (SELECT conv_id, CASE role WHEN 'user' THEN 'scenario' ELSE 'greeting' END AS section, CASE role WHEN 'user' THEN 5 ELSE 6 END AS priority, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations WHERE role IN ('user', 'assistant')) WHERE k = 1 AND length(trim(text)) > 0")
def i12(g):
    c = g.table("conversations").where("role in ('user', 'assistant')")
    first = c.groupBy("conv_id").agg(F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("scenario"), F.min_by(F.when(F.col("role") == "assistant", F.col("text")), F.when(F.col("role") == "assistant", F.col("turn"))).alias("first_mes"))
    none = F.lit(None).cast("string")
    cards = first.select(F.concat(F.lit("Card "), F.col("conv_id").cast("string")).alias("name"), none.alias("description"), none.alias("personality"), "scenario", none.alias("mes_example"), "first_mes")
    return S.card_memories(cards)


@query("m23_archive", "SELECT 'history://scenes/conv_' || conv_id AS uri, count(*) AS turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id")
def m23(g):
    c = g.table("conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line")))).alias("t"))
    return c.select(F.concat(F.lit("history://scenes/conv_"), F.col("conv_id").cast("string")).alias("uri"), "turns", F.array_join(F.transform("t", lambda x: x["line"]), "\n").alias("content"))


@query("st1_access_batch", "SELECT node_uuid, strftime(max(accessed_at), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS n FROM logs GROUP BY 1")
def st1(g):
    return g.logs.groupBy("node_uuid").agg(F.date_format(F.max("accessed_at"), "yyyy-MM-dd HH:mm:ss").alias("last"), F.count("*").alias("n"))


@query("st1_sessions", ", d AS (SELECT *, CASE WHEN accessed_at - lag(accessed_at) OVER (PARTITION BY node_uuid ORDER BY accessed_at) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM logs), n AS (SELECT *, sum(fresh) OVER (PARTITION BY node_uuid ORDER BY accessed_at ROWS UNBOUNDED PRECEDING) AS s FROM d), c AS (SELECT node_uuid, s, count(*) AS n FROM n GROUP BY ALL) SELECT node_uuid, count(*) AS sessions, max(n) AS longest FROM c GROUP BY 1")
def st1s(g):
    s = g.logs.select("node_uuid", F.col("accessed_at").cast("timestamp").alias("accessed_at"))
    return s.groupBy("node_uuid", F.session_window("accessed_at", "12 hours")).agg(F.count("*").alias("n")).groupBy("node_uuid").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))
