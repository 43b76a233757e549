"""Entity versions in batches: every customer's orders as versions, with runs of removed ones, heads among them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import states as O
from ..registry import query
from .legacy import LEGACY, entities
from .legacy import states as orders

_CHAIN = LEGACY + """, ns AS (SELECT id, entity_id, version, o_orderkey, name, 'text ' || o_orderkey AS content, o_orderkey % 2 = 0 AS inheritable, lag(id) OVER (PARTITION BY entity_id ORDER BY version) AS previous FROM sts),
mx AS (SELECT entity_id, max(version) AS top FROM ns GROUP BY 1), cv AS (SELECT m.entity_id, CASE WHEN CAST(substr(m.entity_id, 3) AS BIGINT) % 7 = 0 AND top > 1 THEN top - 1 ELSE top END AS v FROM mx m),
an AS (SELECT *, CASE WHEN o_orderkey % 9 = 0 THEN 'referenced' ELSE 'ok' END AS status FROM ns WHERE version % 4 <> 0),
sv AS (SELECT * FROM ns WHERE id NOT IN (SELECT id FROM an WHERE status = 'ok'))"""
_NEW = _CHAIN + """, rq AS (SELECT l.id AS seq, 'c-' || o_custkey AS entity_id, CASE WHEN l_linenumber % 2 = 0 THEN 'name ' || l.id END AS name, 'new ' || l.id AS content, CASE WHEN l_linenumber % 3 = 0 THEN l_returnflag = 'R' END AS inheritable FROM lv l JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus = 'O'
  UNION ALL SELECT -s_suppkey, 's-' || s_suppkey, 'x', 'y', true FROM supplier),
tp AS (SELECT entity_id, max(version) AS tv, arg_max(id, version) AS tid, arg_max(name, version) AS tn, arg_max(inheritable, version) AS ti FROM ns GROUP BY 1),
nv AS (SELECT rq.*, tv, tid, tn, ti, row_number() OVER w AS k, last_value(rq.name IGNORE NULLS) OVER w AS named, last_value(rq.inheritable IGNORE NULLS) OVER w AS inherits FROM rq JOIN tp USING (entity_id) WINDOW w AS (PARTITION BY entity_id ORDER BY seq ROWS UNBOUNDED PRECEDING))"""


def states(g):
    s = orders(g).withColumn("previous", F.when(F.col("version") > 1, F.concat("entity_id", F.lit("_v"), (F.col("version") - 1).cast("string"))))
    return s.select("id", "entity_id", "version", "name", F.concat(F.lit("text "), F.col("o_orderkey").cast("string")).alias("content"), (F.col("o_orderkey") % 2 == 0).alias("inheritable"), "previous", "o_orderkey")


def removal(g):
    s = states(g)
    top = s.groupBy("entity_id").agg(F.max("version").alias("top"))
    odd = (F.substring("entity_id", 3, 20).cast("long") % 7 == 0) & (F.col("top") > 1)
    current = top.select("entity_id", F.concat("entity_id", F.lit("_v"), F.when(odd, F.col("top") - 1).otherwise(F.col("top")).cast("string")).alias("id"))
    refs = s.where("o_orderkey % 9 = 0").select("id", F.lit(1).alias("n"))
    return O.removed(s.drop("o_orderkey"), current, refs, s.where("version % 4 <> 0").select("id"))


@query("n5_answers", _CHAIN + " SELECT id, status, CASE status WHEN 'ok' THEN 0 ELSE 1 END::BIGINT AS n FROM an")
def n5_answers(g):
    """Which removals are refused, as others lead to the state."""
    return removal(g)[0]


@query("n5_chains", _CHAIN + " SELECT id, entity_id, version, lag(id) OVER (PARTITION BY entity_id ORDER BY version) AS previous FROM sv")
def n5_chains(g):
    """What stays, linked over the runs that go."""
    return removal(g)[1].select("id", "entity_id", "version", "previous")


@query("n5_current", _CHAIN + " SELECT cv.entity_id, arg_max(sv.id, sv.version) AS id FROM cv LEFT JOIN sv ON sv.entity_id = cv.entity_id AND sv.version <= cv.v GROUP BY 1")
def n5_current(g):
    """Where the entities' current pointers fall back to."""
    return removal(g)[2]


@query("n6_emptied", _CHAIN + " SELECT id FROM ent WHERE id NOT IN (SELECT entity_id FROM sv)")
def n6_emptied(g):
    """Entities that can be deleted after the removal: none of their states is left, and with those their edges have gone."""
    return entities(g).join(removal(g)[1].select(F.col("entity_id").alias("id")), "id", "left_anti").select("id")


@query("n2_versions", _NEW + " SELECT entity_id || '_v' || (tv + k) AS id, entity_id, tv + k AS version, coalesce(named, tn) AS name, content, coalesce(inherits, ti) AS inheritable, CASE WHEN k = 1 THEN tid ELSE entity_id || '_v' || (tv + k - 1) END AS previous FROM nv")
def n2_versions(g):
    """New versions from the open lines of all orders, several an entity, fields taken over where they are null."""
    return O.updated(states(g).drop("o_orderkey"), version_requests(g))[1]


@query("n2_answers", _NEW + " SELECT seq, 'ok' AS status, entity_id || '_v' || (tv + k) AS id FROM nv UNION ALL SELECT seq, 'no entity', NULL FROM rq WHERE entity_id NOT IN (SELECT entity_id FROM tp)")
def n2_answers(g):
    return O.updated(states(g).drop("o_orderkey"), version_requests(g))[0]


def version_requests(g):
    from .folds import requests

    n = F.col("l_linenumber")
    lines = requests(g, raw=True).where("l_linestatus = 'O'").join(g.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    text = lambda t: F.concat(F.lit(t), F.col("seq").cast("string"))
    own = lines.select("seq", F.concat(F.lit("c-"), F.col("o_custkey").cast("string")).alias("entity_id"), F.when(n % 2 == 0, text("name ")).alias("name"), text("new ").alias("content"), F.when(n % 3 == 0, F.col("l_returnflag") == "R").alias("inheritable"))
    return own.unionAll(g.table("supplier").select(-F.col("s_suppkey"), F.concat(F.lit("s-"), F.col("s_suppkey").cast("string")), F.lit("x"), F.lit("y"), F.lit(True)))


_LINK = LEGACY + """, rq AS (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 5 < 3 THEN 'link' ELSE 'unlink' END AS op, CASE WHEN o_orderkey % 3 = 0 THEN 'c-' || o_custkey // 2 ELSE 'c-' || o_custkey END AS child, CASE WHEN o_orderkey % 3 = 0 THEN 'c-' || o_custkey ELSE 'c-' || o_custkey // 2 END AS parent FROM orders
  UNION ALL SELECT -s_suppkey, 'link', 's-' || s_suppkey, 'c-1' FROM supplier UNION ALL SELECT -1000000 - c_custkey, 'link', 'c-' || c_custkey, 'c-' || c_custkey FROM customer),
l0 AS (SELECT 'c-' || c_custkey AS child, 'c-' || c_custkey // 2 AS parent FROM customer WHERE c_custkey % 4 = 1 AND c_custkey > 1),
ck AS (SELECT *, CASE WHEN child = parent THEN 'self' WHEN child NOT IN (SELECT id FROM ent) OR parent NOT IN (SELECT id FROM ent) THEN 'no entity' END AS bad, least(child, parent) AS lo, greatest(child, parent) AS hi FROM rq),
ox AS (SELECT *, row_number() OVER (PARTITION BY lo, hi ORDER BY seq) AS k, CASE WHEN child < parent THEN 1 ELSE 2 END AS bit FROM ck WHERE bad IS NULL),
h0 AS (SELECT least(child, parent) AS lo, greatest(child, parent) AS hi, CAST(sum(CASE WHEN child < parent THEN 1 ELSE 2 END) AS INT) AS had FROM l0 GROUP BY ALL),
fo AS (SELECT p.lo, p.hi, 0::BIGINT AS k, coalesce(had, 0) AS s, 0::BIGINT AS seq, '' AS status FROM (SELECT DISTINCT lo, hi FROM ox) p LEFT JOIN h0 ON h0.lo = p.lo AND h0.hi = p.hi
  UNION ALL SELECT lo, hi, k, CASE WHEN status <> 'ok' THEN s WHEN op = 'link' THEN s | bit ELSE s & ~bit END, seq, status FROM (SELECT ox.*, fo.s, CASE WHEN ox.op = 'link' THEN CASE WHEN fo.s & ox.bit > 0 THEN 'exists' WHEN fo.s > 0 THEN 'mutual' ELSE 'ok' END ELSE CASE WHEN fo.s & ox.bit > 0 THEN 'ok' ELSE 'missing' END END AS status
    FROM fo JOIN ox ON ox.lo = fo.lo AND ox.hi = fo.hi AND ox.k = fo.k + 1))"""


def belonging(g):
    c, o = g.table("customer"), g.table("orders")
    tag = lambda x: F.concat(F.lit("c-"), x.cast("string"))
    key, half = F.col("o_custkey"), F.floor(F.col("o_custkey") / 2)
    turned = F.col("o_orderkey") % 3 == 0
    req = o.select(F.col("o_orderkey").cast("long").alias("seq"), F.when(F.col("o_orderkey") % 5 < 3, "link").otherwise("unlink").alias("op"), tag(F.when(turned, half).otherwise(key)).alias("child"), tag(F.when(turned, key).otherwise(half)).alias("parent"))
    s = g.table("supplier").select((-F.col("s_suppkey")).cast("long"), F.lit("link"), F.concat(F.lit("s-"), F.col("s_suppkey").cast("string")), F.lit("c-1"))
    self = c.select((-1000000 - F.col("c_custkey")).cast("long"), F.lit("link"), tag(F.col("c_custkey")), tag(F.col("c_custkey")))
    links = c.where("c_custkey % 4 = 1 and c_custkey > 1").select(tag(F.col("c_custkey")).alias("child"), tag(F.floor(F.col("c_custkey") / 2)).alias("parent"))
    return O.belonging(entities(g).select("id"), links, req.unionAll(s).unionAll(self))


@query("n10_answers", _LINK + " SELECT seq, status FROM fo WHERE k > 0 UNION ALL SELECT seq, bad FROM ck WHERE bad IS NOT NULL")
def n10_answers(g):
    """Links and unlinks of customers, some fifteen a pair, each upon what the one before has left."""
    return belonging(g)[0]


@query("n10_links", _LINK + """, fi AS (SELECT lo, hi, arg_max(s, k) AS s FROM fo GROUP BY ALL) SELECT lo AS child, hi AS parent FROM fi WHERE s & 1 > 0 UNION ALL SELECT hi, lo FROM fi WHERE s & 2 > 0
UNION ALL SELECT child, parent FROM l0 WHERE NOT EXISTS (SELECT 1 FROM fi WHERE fi.lo = least(child, parent) AND fi.hi = greatest(child, parent))""")
def n10_links(g):
    """Who belongs to whom after the batch."""
    return belonging(g)[1]
