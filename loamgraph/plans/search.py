"""Full-text search and glossary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import phrases as P
from ..operators import search as S
from ..registry import query

ASKED = [(1, "the and"), (2, "der die"), (3, "que los"), (4, "nosuchword idiot"), (5, "src3://7 of"), (6, "Été clown")]
_VALUES = ", ".join(f"({i}, '{q}')" for i, q in ASKED)
_TOK = "regexp_extract_all({}, '[\\p{{L}}\\p{{N}}]+')"
_F1 = "list_distinct(regexp_extract_all(regexp_replace({}, '[:/.\\-]+', ' ', 'g'), '[A-Za-z0-9_]+|[一-鿿]+'))"
_TERMS = f"array_to_string({_F1.format('concat_ws(chr(32), words, path, uri, content)')}, ' ')"
_BASE = f""", gw AS (SELECT node_uuid AS n, string_agg(keyword, ' ' ORDER BY keyword) AS words FROM glossary GROUP BY 1),
sd AS (SELECT d.*, coalesce(words, '') AS words FROM docs d LEFT JOIN gw ON d.node_uuid = gw.n),
se AS (SELECT *, {_TERMS} AS terms FROM sd),
"""
F6 = (
    _BASE
    + f"""tk AS (SELECT doc_id, unnest({_TOK.format("strip_accents(lower(path))")}) AS term, 2.5::DOUBLE AS w FROM se UNION ALL SELECT doc_id, unnest({_TOK.format("strip_accents(lower(uri))")}), 2.0::DOUBLE FROM se
  UNION ALL SELECT doc_id, unnest({_TOK.format("strip_accents(lower(content))")}), 1.0::DOUBLE FROM se UNION ALL SELECT doc_id, unnest({_TOK.format("strip_accents(lower(terms))")}), 0.75::DOUBLE FROM se),
sz AS (SELECT s.doc_id, coalesce(t.n, 0) AS size FROM se s LEFT JOIN (SELECT doc_id, count(*) AS n FROM tk GROUP BY 1) t ON s.doc_id = t.doc_id),
tot AS (SELECT count(*) AS n_docs, avg(size) AS avg_size FROM sz),
qs(query_id, query) AS (VALUES {_VALUES}),
qt AS (SELECT DISTINCT query_id, unnest({_TOK.format("lower(array_to_string(" + _F1.format("query") + ", ' '))")}) AS term FROM qs),
qn AS (SELECT query_id, count(*) AS asked FROM qt GROUP BY 1),
po AS (SELECT term, doc_id, sum(w)::DOUBLE AS f FROM tk WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM po GROUP BY 1),
sc AS (SELECT qt.query_id, po.doc_id, count(*) AS found, round(-sum(greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / avg_size))), 6) AS score
  FROM po JOIN dfs USING (term) JOIN sz USING (doc_id) JOIN qt USING (term), tot GROUP BY ALL),
rk AS (SELECT sc.query_id, sc.doc_id, se.node_uuid, CAST(found < asked AS INT) AS pass, score, row_number() OVER (PARTITION BY sc.query_id ORDER BY found < asked, score, priority, length(path), sc.doc_id) AS rank
  FROM sc JOIN qn USING (query_id) JOIN se ON se.doc_id = sc.doc_id)
"""
)


def asked(g):
    return g.spark.createDataFrame(ASKED, "query_id int, query string")


@query("f5_search", F6 + "SELECT query_id, CAST(rank AS INT) AS rank, pass, node_uuid, doc_id, score FROM rk WHERE rank <= 10")
def f5(g):
    return S.search(g.documents, asked(g), 10, index=(g.postings, g.sizes))


@query("f10_search_hundred", F6 + "SELECT query_id, CAST(rank AS INT) AS rank, pass, node_uuid, doc_id, score FROM rk WHERE rank <= 100")
def f10(g):
    return S.search(g.documents, asked(g), 100, index=(g.postings, g.sizes))


@query("q22_search_everywhere", F6.replace("PARTITION BY sc.query_id ORDER BY", "PARTITION BY sc.query_id, se.namespace ORDER BY").replace("se.node_uuid, CAST", "se.node_uuid, se.namespace, se.uri, CAST") + "SELECT query_id, namespace, CAST(rank AS INT) AS rank, doc_id FROM rk WHERE rank <= 10 AND starts_with(uri, 'src1://')")
def q22(g):
    """The best ten of every namespace, of which those of one domain are kept."""
    got = S.search(g.documents, asked(g), 10, index=(g.postings, g.sizes), each=("namespace",))
    return got.join(g.documents.where(F.col("uri").startswith("src1://")).select("doc_id"), "doc_id").select("query_id", "namespace", "rank", "doc_id")


@query("f1_tokens", f"SELECT item_id, unnest({_F1.format('text')}) AS token FROM benchmark")
def f1(g):
    return g.table("benchmark").select("item_id", F.explode(T.search_tokens(F.col("text"))).alias("token"))


@query("f4_search_documents", _BASE.rstrip().rstrip(",") + " SELECT doc_id, uri, words, len(" + _F1.format("concat_ws(chr(32), words, path, uri, content)") + ") AS n_terms FROM se")
def f4(g):
    d = S.search_documents(g.documents, g.glossary)
    return d.select("doc_id", "uri", F.coalesce("words", F.lit("")).alias("words"), F.when(F.col("terms") == "", 0).otherwise(F.size(F.split("terms", " "))).cast("long").alias("n_terms"))


@query("f8_snippet", """, h AS (SELECT doc_id, content, CASE WHEN contains(lower(content), 'the idiot') THEN 'the idiot' WHEN contains(lower(content), 'the') THEN 'the' WHEN contains(lower(content), 'idiot') THEN 'idiot' END AS needle FROM docs),
p AS (SELECT *, instr(lower(content), needle) AS hit FROM h), b AS (SELECT *, greatest(hit - 30, 1) AS b, least(hit + length(needle) + 30, length(content) + 1) AS e FROM p)
SELECT doc_id, CASE WHEN needle IS NULL THEN CASE WHEN length(content) > 80 THEN substr(content, 1, 80) || '...' ELSE content END
 ELSE (CASE WHEN b > 1 THEN '...' ELSE '' END) || substr(content, b, e - b) || (CASE WHEN e <= length(content) THEN '...' ELSE '' END) END AS snippet FROM b""")
def f8(g):
    return g.documents.select("doc_id", S.hit_snippet(F.col("content"), F.lit("The idiot")).alias("snippet"))


@query("f9_all_keywords", "SELECT doc_id, 1.0::DOUBLE AS score, CASE WHEN length(content) > 100 THEN substr(content, 1, 100) || ' [truncated]' ELSE content END AS snippet FROM docs WHERE contains(lower(content), 'the') AND contains(lower(content), 'of')")
def f9(g):
    words = F.array(F.lit("the"), F.lit("of"))
    low = F.lower("content")
    return g.documents.where(F.forall(words, lambda k: F.contains(low, k))).select("doc_id", F.lit(1.0).alias("score"), T.snippet(F.col("content"), 100, " [truncated]").alias("snippet"))


@query("g3_node_keywords", "SELECT node_uuid, keyword, row_number() OVER (PARTITION BY node_uuid ORDER BY keyword) AS k FROM glossary")
def g3(g):
    return g.glossary.groupBy("node_uuid").agg(F.array_sort(F.collect_list("keyword")).alias("ks")).select("node_uuid", F.posexplode("ks")).select("node_uuid", F.col("col").alias("keyword"), (F.col("pos") + 1).cast("long").alias("k"))


@query("g4_glossary", """SELECT g.keyword, g.node_uuid, coalesce(d.uri, 'unlinked://' || g.node_uuid) AS uri, CASE WHEN length(d.content) > 100 THEN replace(substr(d.content, 1, 100), chr(10), ' ') || '...' ELSE replace(d.content, chr(10), ' ') END AS snippet
FROM glossary g LEFT JOIN docs d ON d.node_uuid = g.node_uuid AND d.namespace = 'en'""")
def g4(g):
    d = g.documents.where("namespace = 'en'").select(F.col("node_uuid").alias("n"), "uri", "content")
    flat = F.replace(T.snippet(F.col("content"), 100), F.lit("\n"), F.lit(" "))
    return g.glossary.join(d, F.col("node_uuid") == F.col("n"), "left").select("keyword", "node_uuid", F.coalesce("uri", F.concat(F.lit("unlinked://"), "node_uuid")).alias("uri"), flat.alias("snippet"))


@query("g5_scan", "SELECT d.doc_id, g.keyword, g.node_uuid AS target FROM docs d JOIN glossary g ON contains(d.content, g.keyword)")
def g5(g):
    hits = S.glossary_hits(g.documents, g.glossary)
    return hits.join(g.glossary.select("keyword", F.col("node_uuid").alias("target")), "keyword").select("doc_id", "keyword", "target")


@query("g7_cross_links", """, hit AS (SELECT d.doc_id, d.node_uuid, g.keyword, g.node_uuid AS target FROM docs d JOIN glossary g ON contains(d.content, g.keyword))
SELECT h.doc_id, t.uri, count(*) AS n, string_agg(h.keyword, ',' ORDER BY h.keyword) AS keywords FROM hit h JOIN docs t ON t.node_uuid = h.target WHERE h.target <> h.node_uuid GROUP BY ALL""")
def g7(g):
    hits = S.glossary_hits(g.documents, g.glossary).join(g.glossary.select("keyword", F.col("node_uuid").alias("target")), "keyword")
    t = g.documents.select(F.col("node_uuid").alias("target"), "uri")
    got = hits.join(t, "target").where(F.col("target") != F.concat(F.lit("d-"), F.col("doc_id").cast("string")))
    return got.groupBy("doc_id", "uri").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("keyword")), ",").alias("keywords"))


@query("g9_corpus_scan", "SELECT g.keyword, count(*) AS documents, sum((length(d.content) - length(replace(d.content, g.keyword, ''))) // length(g.keyword))::BIGINT >= count(*) AS enough, max(CASE WHEN d.node_uuid = g.node_uuid THEN 1 ELSE 0 END) AS self FROM docs d JOIN glossary g ON contains(d.content, g.keyword) GROUP BY 1")
def g9(g):
    hits = S.glossary_hits(g.documents, g.glossary).join(g.glossary.select("keyword", "node_uuid"), "keyword")
    own = F.max((F.concat(F.lit("d-"), F.col("doc_id").cast("string")) == F.col("node_uuid")).cast("int"))
    return hits.groupBy("keyword").agg(F.count("*").alias("documents"), (F.sum("hits") >= F.count("*")).alias("enough"), own.alias("self"))


@query("j4_composite", "SELECT a.doc_id, b.priority FROM docs a JOIN docs b ON a.namespace = b.namespace AND a.domain = b.domain AND a.path = b.path")
def j4(g):
    d = g.documents
    return d.select("namespace", "domain", "path", "doc_id").join(d.select("namespace", "domain", "path", "priority"), ["namespace", "domain", "path"]).select("doc_id", "priority")


@query("g9_locations", "SELECT g.keyword, d.uri, d.node_uuid = g.node_uuid AS self FROM docs d JOIN glossary g ON contains(d.content, g.keyword)")
def g9_locations(g):
    """Every place where a keyword stands, and whether it is the keyword's own node."""
    hits = S.glossary_hits(g.documents, g.glossary).join(g.glossary.select("keyword", F.col("node_uuid").alias("target")), "keyword")
    return hits.join(g.documents.select("doc_id", "uri", "node_uuid"), "doc_id").select("keyword", "uri", (F.col("node_uuid") == F.col("target")).alias("self"))


_TOKENS = """tk AS (SELECT doc_id, unnest({}) AS term, 2.5::DOUBLE AS w FROM se UNION ALL SELECT doc_id, unnest({}), 2.0::DOUBLE FROM se UNION ALL SELECT doc_id, unnest({}), 1.0::DOUBLE FROM se UNION ALL SELECT doc_id, unnest({}), 0.75::DOUBLE FROM se)
""".format(*[_TOK.format(f"strip_accents(lower({c}))") for c in ("path", "uri", "content", "terms")])


@query("f4b_refresh", _BASE.replace("docs d LEFT JOIN gw", "(SELECT * REPLACE (CASE WHEN doc_id % 7 = 0 THEN 'renewed text ' || doc_id ELSE content END AS content) FROM docs WHERE doc_id % 11 <> 0) d LEFT JOIN gw") + _TOKENS + "SELECT doc_id, count(*) AS size, count(DISTINCT term) AS terms, round(sum(w), 2) AS weight, bool_or(term = 'renewed') AS renewed FROM tk GROUP BY 1")
def f4b(g):
    """The kept index after every seventh text has changed and every eleventh document has gone."""
    k = F.col("doc_id")
    now = g.documents.where(k % 11 != 0).withColumn("content", F.when(k % 7 == 0, F.concat(F.lit("renewed text "), k.cast("string"))).otherwise(F.col("content")))
    posts, _ = S.refreshed((g.postings, g.sizes), S.search_documents(now.where(k % 7 == 0), g.glossary), g.documents.where((k % 7 == 0) | (k % 11 == 0)))
    return posts.groupBy("doc_id").agg(F.sum("n").alias("size"), F.count("*").alias("terms"), F.round(F.sum("f"), 2).alias("weight"), F.max(F.col("term") == "renewed").alias("renewed"))


# the places of the terms matter here, so they are put in the order of their first ones
@query("f7_cover_search", _BASE + f"""t0 AS (SELECT doc_id, {_F1.removeprefix("list_distinct(")[:-1].format("concat_ws(chr(32), words, path, uri, content)")} AS ws FROM sd),
t1 AS (SELECT doc_id, term, min(i) AS i FROM (SELECT doc_id, unnest(ws) AS term, unnest(range(len(ws))) AS i FROM t0) GROUP BY ALL),
t2 AS (SELECT doc_id, string_agg(term, ' ' ORDER BY i) AS ordered FROM t1 GROUP BY 1),
tx AS (SELECT se.doc_id, {_TOK.format("strip_accents(lower(concat_ws(' ', path, uri, content, ordered)))")} AS ts FROM se LEFT JOIN t2 ON t2.doc_id = se.doc_id),
pl AS (SELECT doc_id, unnest(ts) AS term, unnest(range(len(ts))) AS pos FROM tx),
qs(query_id, query) AS (VALUES {_VALUES}),
qt AS (SELECT DISTINCT query_id, unnest({_TOK.format("lower(array_to_string(" + _F1.format("query") + ", ' '))")}) AS term FROM qs),
qn AS (SELECT query_id, count(*) AS asked FROM qt GROUP BY 1),
hi AS (SELECT query_id, doc_id, pos, term, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY pos) AS i FROM pl JOIN qt USING (term)),
hv AS (SELECT query_id, doc_id, count(DISTINCT term) AS found, count(*) AS n FROM hi GROUP BY ALL),
la AS (SELECT h.query_id, h.doc_id, h.pos, h.i, qt.term, max(CASE WHEN qt.term = h.term THEN h.pos END) OVER w AS lp, max(CASE WHEN qt.term = h.term THEN h.i END) OVER w AS li FROM hi h JOIN qt ON qt.query_id = h.query_id WINDOW w AS (PARTITION BY h.query_id, h.doc_id, qt.term ORDER BY h.pos ROWS UNBOUNDED PRECEDING)),
en AS (SELECT query_id, doc_id, pos, i, min(lp) AS bp, min(li) AS bi FROM la GROUP BY ALL HAVING count(*) = count(lp)),
co AS (SELECT query_id, doc_id, bp, bi, min(pos) AS ep, min(i) AS ei FROM en GROUP BY ALL),
de AS (SELECT query_id, doc_id, sum(0.1::DOUBLE / (1 + (ep - bp) - (ei - bi))) AS dense FROM co GROUP BY ALL),
sc AS (SELECT hv.query_id, hv.doc_id, CAST(found < asked AS INT) AS pass, round(CASE WHEN found < asked THEN n * 0.1::DOUBLE ELSE dense END, 6) AS score FROM hv JOIN qn USING (query_id) LEFT JOIN de ON de.query_id = hv.query_id AND de.doc_id = hv.doc_id),
rk AS (SELECT sc.*, row_number() OVER (PARTITION BY query_id ORDER BY pass, score DESC, priority, length(path), sc.doc_id) AS rank FROM sc JOIN se ON se.doc_id = sc.doc_id)
SELECT query_id, CAST(rank AS INT) AS rank, pass, doc_id, score FROM rk WHERE rank <= 10""")
def f7(g):
    return S.cover_search(g.documents, asked(g), posts=g.postings)


# the search terms in the order of their first places
_ORDERED = f""", t0 AS (SELECT doc_id, {_F1.removeprefix("list_distinct(")[:-1].format("concat_ws(chr(32), words, path, uri, content)")} AS ws FROM sd),
t1 AS (SELECT doc_id, term, min(i) AS i FROM (SELECT doc_id, unnest(ws) AS term, unnest(range(len(ws))) AS i FROM t0) GROUP BY ALL), t2 AS (SELECT doc_id, string_agg(term, ' ' ORDER BY i) AS ordered FROM t1 GROUP BY 1), so AS (SELECT se.*, ordered FROM se LEFT JOIN t2 USING (doc_id))"""
_PLACES = _ORDERED + ", ".join(["", *[f"tc{n} AS (SELECT doc_id, {n} AS c, {_TOK.format(f'strip_accents(lower({c}))')} AS ts FROM so)" for n, c in ((0, "path"), (1, "uri"), (2, "content"), (4, "ordered"))]])
_QUERY = "replace(array_to_string(string_split(text, ' ')[2:3], '_'), chr(10), ' ') || ' ' || string_split(text, ' ')[4]"


@query("f5_phrases", _BASE.rstrip().rstrip(",") + _PLACES + f""", pl AS (SELECT doc_id, c, unnest(ts) AS term, unnest(range(len(ts))) AS pos FROM (SELECT * FROM tc0 UNION ALL SELECT * FROM tc1 UNION ALL SELECT * FROM tc2 UNION ALL SELECT * FROM tc4)),
sz AS (SELECT se.doc_id, coalesce(n, 0) AS size FROM se LEFT JOIN (SELECT doc_id, count(*) AS n FROM pl GROUP BY 1) t ON t.doc_id = se.doc_id), tot AS (SELECT count(*) AS n_docs, avg(size) AS avg_size FROM sz),
qs AS (SELECT item_id AS query_id, {_QUERY} AS query FROM benchmark WHERE len(string_split(text, ' ')) >= 4),
qt AS (SELECT DISTINCT query_id, {_TOK.format("strip_accents(lower(token))")} AS terms FROM (SELECT query_id, unnest({_F1.format("query")}) AS token FROM qs)), qp AS (SELECT *, array_to_string(terms, ' ') AS phrase FROM qt WHERE len(terms) > 0),
qn AS (SELECT query_id, count(*) AS asked FROM qp GROUP BY 1), pt AS (SELECT phrase, len(terms) AS many, unnest(terms) AS term, unnest(range(len(terms))) AS off FROM (SELECT DISTINCT phrase, terms FROM qp)),
be AS (SELECT phrase, many, doc_id, c, pos - off AS b FROM pt JOIN pl USING (term) GROUP BY ALL HAVING count(*) = many),
po AS (SELECT phrase, doc_id, sum(CASE c WHEN 0 THEN 2.5 WHEN 1 THEN 2.0 WHEN 4 THEN 0.75 ELSE 1.0 END)::DOUBLE AS f FROM be GROUP BY ALL), dfs AS (SELECT phrase, count(*) AS df FROM po GROUP BY 1),
sc AS (SELECT qp.query_id, po.doc_id, count(*) AS found, round(-sum(greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / avg_size))), 6) AS score FROM po JOIN dfs USING (phrase) JOIN sz USING (doc_id) JOIN qp USING (phrase), tot GROUP BY ALL),
rk AS (SELECT sc.query_id, sc.doc_id, se.node_uuid, CAST(found < asked AS INT) AS pass, score, row_number() OVER (PARTITION BY sc.query_id ORDER BY found < asked, score, priority, length(path), sc.doc_id) AS rank FROM sc JOIN qn USING (query_id) JOIN se ON se.doc_id = sc.doc_id)
SELECT query_id, CAST(rank AS INT) AS rank, pass, node_uuid, doc_id, score FROM rk WHERE rank <= 10""")
def f5_phrases(g):
    """The second to fourth words of every benchmark text, the first two of them as one phrase, searched for everywhere."""
    w = F.split("text", " ")
    b = g.table("benchmark").where(F.size(w) >= 4)
    asked_ = b.select(F.col("item_id").alias("query_id"), F.concat(F.replace(F.array_join(F.slice(w, 2, 2), "_"), F.lit("\n"), F.lit(" ")), F.lit(" "), F.element_at(w, 4)).alias("query"))
    return P.phrase_search(g.documents, asked_, g.postings, g.sizes)
