"""Segmentation over the benchmark's texts, whose letters are written as CJK signs without spaces for it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import segment as G
from ..registry import query

LETTERS, SIGNS = "abcdefghijklmnopqrstuvwxyz", "天地人山水火木金土日月星风云雨雪花草鸟鱼虫牛马羊石田"
_RUN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{3040}-\x{30ff}\x{31f0}-\x{31ff}\x{ac00}-\x{d7af}]+"
_CJK = f"translate(replace(lower({{}}), ' ', ''), '{LETTERS}', '{SIGNS}')"


def _walk(name: str, runs: str, words: str) -> str:
    """CTEs for the best paths of ``runs(run)`` over ``words(word, score)``: {name}(run, p) with p the words joined by bars."""
    return f"""{name}_g AS (SELECT run, i + k - 1 AS e, k, substr(run, i, k) AS word FROM (SELECT run, unnest(range(1, length(run) + 1)) AS i FROM {runs}), (SELECT unnest(range(1, 41)) AS k) WHERE i + k - 1 <= length(run)),
{name}_e AS (SELECT run, e, list(struct_pack(k := k, s := score)) AS ks FROM (SELECT g.run, g.e, g.k, coalesce(w.score, u.unknown) AS score FROM {name}_g g LEFT JOIN {words} w ON w.word = g.word, un u WHERE w.word IS NOT NULL OR g.k = 1) GROUP BY ALL),
{name}_d AS (SELECT run, 0::BIGINT AS i, [0::BIGINT] AS s, [''] AS p FROM {runs} UNION ALL
  SELECT run, i + 1, list_append(s, b.sc), list_append(p, p[i + 2 - b.k] || '|' || substr(run, i + 2 - b.k, b.k)) FROM (
    SELECT d.*, list_max(list_transform(e.ks, lambda x: struct_pack(sc := d.s[d.i + 2 - x.k] + x.s, k := x.k))) AS b FROM {name}_d d JOIN {name}_e e ON e.run = d.run AND e.e = d.i + 1)),
{name} AS (SELECT run, s[-1] AS score, substr(p[-1], 2) AS p FROM {name}_d WHERE i = length(run))"""


SQL = f""", cj AS (SELECT item_id, unnest(regexp_extract_all({_CJK.format("text")}, '{_RUN}')) AS run FROM benchmark),
rd AS (SELECT run, count(*) AS n FROM cj GROUP BY 1),
gr AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, substr(run, i, k) AS word FROM (SELECT run, n, unnest(range(1, length(run) + 1)) AS i FROM rd), (SELECT unnest(range(1, 5)) AS k) WHERE i + k - 1 <= length(run)) GROUP BY 1),
tt AS (SELECT sum(n) AS t FROM gr WHERE length(word) = 1),
ca AS (SELECT word, n, substr(word, 1, s) AS l, substr(word, s + 1) AS r FROM gr, (SELECT unnest(range(1, 4)) AS s) WHERE length(word) > s AND n >= {G.LEAST}),
kp AS (SELECT ca.word, any_value(ca.n) AS n FROM ca JOIN gr a ON a.word = ca.l JOIN gr b ON b.word = ca.r, tt GROUP BY 1 HAVING bool_and(CAST(ca.n AS DOUBLE) * t >= {G.COHESION} * CAST(a.n AS DOUBLE) * b.n)),
kn AS (SELECT word, n FROM gr WHERE length(word) = 1 UNION ALL SELECT word, n FROM kp),
nm AS (SELECT DISTINCT {_CJK.format("keyword")} AS word FROM glossary), nr AS (SELECT word AS run FROM nm WHERE regexp_full_match(word, '{_RUN}')),
aw AS (SELECT word, n, true AS base FROM kn UNION ALL SELECT run, coalesce(gr.n, 1), false FROM nr LEFT JOIN gr ON gr.word = run WHERE run NOT IN (SELECT word FROM kn)),
ww AS (SELECT CAST(sum(n) AS DOUBLE) AS w FROM aw), un AS (SELECT CAST(floor(1000 * ln(0.5::DOUBLE / w)) AS BIGINT) AS unknown FROM ww),
sc AS (SELECT word, CAST(floor(1000 * ln(n / w)) AS BIGINT) AS score, base FROM aw, ww), sb AS (SELECT word, score FROM sc WHERE base),
{_walk("ap", "nr", "sb")},
lx AS (SELECT sc.word, greatest(sc.score, coalesce(ap.score + 1, sc.score)) AS score FROM sc LEFT JOIN ap ON ap.run = sc.word),
{_walk("bp", "rd", "lx")}"""


def frames(g):
    cjk = lambda c: F.translate(F.replace(F.lower(c), F.lit(" "), F.lit("")), LETTERS, SIGNS)
    texts = g.table("benchmark").select("item_id", cjk(F.col("text")).alias("text"))
    return texts, G.lexicon(texts, g.glossary.select(cjk(F.col("keyword")).alias("keyword")))


@query("f1_lexicon", SQL + " SELECT word, score FROM lx")
def f1_lexicon(g):
    """The words of texts without spaces, with their weights."""
    return frames(g)[1].where("word <> ''")


@query("f1_paths", SQL + " SELECT run, p AS words, score FROM bp")
def f1_paths(g):
    """The most probable words of every run."""
    texts, words = frames(g)
    runs = texts.select(F.explode(G.runs_of(F.col("text"))).alias("run"))
    return G.paths(runs, words).select("run", F.array_join("words", "|").alias("words"), "score")


@query("f3_segmented", SQL + """, wd AS (SELECT run, string_split(p, '|') AS ws FROM bp), wo AS (SELECT run, unnest(ws) AS word FROM wd),
sw AS (SELECT DISTINCT run, word FROM wo UNION SELECT run, substr(word, i, k) FROM (SELECT run, word, unnest(range(1, length(word))) AS i FROM wo), (VALUES (2), (3)) x(k)
  WHERE length(word) > k AND i + k - 1 <= length(word) AND substr(word, i, k) IN (SELECT word FROM lx))
SELECT DISTINCT item_id, word AS token FROM cj JOIN sw USING (run)""")
def f3_segmented(g):
    """The distinct search tokens of every text, runs split into words and their parts."""
    texts, words = frames(g)
    return G.tokens(texts, "item_id", F.col("text"), words).select("item_id", F.explode("tokens").alias("token")).distinct()
