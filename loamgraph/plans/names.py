"""The older graph's records, read as text and given free paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import names as O
from ..registry import query
from .legacy import entities
from .relays import RELAYS, chapters, directs

#: Entities, relations (one for each version that carries them) and chapters; every seventh relation's viewer is unknown.
#: Taken are the first numbered names of every second viewer's chapters and every fifth entity.
_SQL = RELAYS.rstrip() + """, rd AS (SELECT CAST(substr(id, 3) AS BIGINT) AS seq, id, 'about ' || id AS content FROM ent UNION ALL SELECT -CAST(substr(id, 3) AS BIGINT), 'relay__' || id, 'x' FROM ent
  UNION ALL SELECT 1000000000 + k * 1000 + CAST(substr(target, 3) AS BIGINT), 'rel:' || CASE WHEN k % 7 = 0 THEN 'nobody' ELSE viewer END || '>' || target, '@relation: ' || relation || chr(10) || chr(10) || content FROM di
  UNION ALL SELECT 1000000000000 + 2 * (k * 1000 + CAST(substr(target, 3) AS BIGINT)) + CASE chapter WHEN 'late' THEN 1 ELSE 0 END, 'chap:' || viewer || '>' || target || ':chapter', chapter FROM ch),
tk AS (SELECT DISTINCT viewer || '/' || target || '/chapter' || CASE WHEN CAST(substr(target, 3) AS BIGINT) % 3 = 0 THEN '' ELSE '_1' END AS path FROM ch WHERE CAST(substr(viewer, 3) AS BIGINT) % 2 = 0 UNION SELECT id FROM ent WHERE CAST(substr(id, 3) AS BIGINT) % 5 = 0),
ps AS (SELECT *, CASE WHEN id LIKE 'chap:%' THEN 'chapter' WHEN id LIKE 'rel:%' THEN 'relation' WHEN id LIKE 'relay%' THEN 'relay' ELSE 'entity' END AS kind, regexp_replace(regexp_replace(id, '^(rel|chap):', ''), '[>:]', '/', 'g') AS path FROM rd),
pz AS (SELECT *, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS up FROM ps), kn AS (SELECT path FROM tk UNION SELECT path FROM pz WHERE kind <> 'relay'),
sx AS (SELECT *, CASE WHEN kind = 'relay' THEN 'relay' WHEN up <> '' AND up NOT IN (SELECT path FROM kn) THEN 'no parent' ELSE 'ok' END AS status FROM pz),
wr AS (SELECT seq, path, row_number() OVER (PARTITION BY path ORDER BY seq) AS j FROM sx WHERE status = 'ok'), bs AS (SELECT path, max(j) AS m FROM wr GROUP BY 1),
hd AS (SELECT path FROM tk UNION SELECT path FROM wr),
fr AS (SELECT base, cand, row_number() OVER (PARTITION BY base ORDER BY n) AS j FROM (SELECT path AS base, n, CASE WHEN n = 0 THEN path ELSE path || '_' || n END AS cand FROM (SELECT path, unnest(range(m + 3)) AS n FROM bs)) c WHERE NOT EXISTS (SELECT 1 FROM hd WHERE hd.path = c.cand AND n > 0) AND NOT EXISTS (SELECT 1 FROM tk WHERE tk.path = c.cand AND n = 0))"""


def records(g):
    number = lambda c: F.substring(c, 3, 20).try_cast("long")
    e, d, c = entities(g), directs(g), chapters(g)
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    at = F.col("k") * 1000 + number("target")
    viewer = F.when(F.col("k") % 7 == 0, "nobody").otherwise(F.col("viewer"))
    rows = e.select(number("id").alias("seq"), "id", text("about ", F.col("id")).alias("content")).unionAll(e.select(-number("id"), text("relay__", F.col("id")), F.lit("x")))
    rows = rows.unionAll(d.select(10**9 + at, text("rel:", viewer, ">", F.col("target")), text("@relation: ", F.col("relation"), "\n\n", F.col("content"))))
    rows = rows.unionAll(c.select(10**12 + 2 * at + F.when(F.col("chapter") == "late", 1).otherwise(0), text("chap:", F.col("viewer"), ">", F.col("target"), ":chapter"), "chapter"))
    end = F.when(number("target") % 3 == 0, "").otherwise("_1")
    taken = c.where(number("viewer") % 2 == 0).select(text(F.col("viewer"), "/", F.col("target"), "/chapter", end).alias("path")).union(e.where(number("id") % 5 == 0).select("id")).distinct()
    return rows, taken


@query("i13_records", _SQL + """ SELECT sx.seq, kind, coalesce(cand, sx.path) AS path, CASE WHEN kind = 'relation' THEN regexp_extract(content, '^@relation: ([^\\n]*)\\n\\n', 1) END AS relation,
  CASE WHEN kind = 'relation' THEN regexp_replace(content, '^@relation: ([^\\n]*)\\n\\n', '') ELSE content END AS content, status FROM sx LEFT JOIN wr ON wr.seq = sx.seq LEFT JOIN fr ON fr.base = wr.path AND fr.j = wr.j""")
def i13_records(g):
    """Entities, relations and chapters from text records, each under a path of its own."""
    return O.imported(*records(g))
