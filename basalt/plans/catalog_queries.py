"""Queries of the catalog operators over the driver tables, with the SQL that checks them.

The tables don't hold catalog records, so each query maps them onto some: orders are
snapshots, finished ones also tombstones, line items observations, conversations
revision graphs, events two revisions of a bucketed set.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from basalt.functions import scalars as fn, strict_json as sj
from basalt.operators import graph, layout, merge, packs, records, shards, validate
from basalt.operators.ordered_digest import ordered_digest
from basalt.plans import schemas
from basalt.plans.limits import ROUTE_DOMAIN
from basalt.plans.durable import checkpoint, scratch, written
from basalt.sources import store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt out by ``key`` over all cores, before work that takes long for each: a table's file may be one task."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


# carriers



def order_id():
    return F.col("o_orderkey").cast("string")


def item_id():
    return F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))


DOMAIN = ROUTE_DOMAIN


def body_of_order():
    return fn.canonical_json(F.struct(F.col("o_custkey").alias("custkey"), F.col("o_orderpriority").alias("epoch"), F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")))


def body_of_item():
    return fn.canonical_json(F.struct(F.col("l_orderkey").alias("package"), F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("status"), F.col("l_suppkey").alias("supplier")))


def snapshots(spark, sf_dir) -> DataFrame:
    """kind, identity, body, epoch, route, bytes of orders."""
    o = table(spark, sf_dir, "orders").select(F.lit("snapshot").alias("kind"), order_id().alias("identity"), body_of_order().alias("body"), F.col("o_orderpriority").alias("epoch"), "o_orderstatus", "o_custkey")
    return o.withColumn("route", fn.route_hash(F.col("kind"), F.col("identity"))).withColumn("bytes", F.octet_length("body").cast("bigint"))


def observations(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.lit("observation").alias("kind"), item_id().alias("identity"), body_of_item().alias("body"))


BODY_O = "to_json({'custkey': o_custkey, 'epoch': o_orderpriority, 'key': o_orderkey, 'status': o_orderstatus})::VARCHAR"
BODY_L = "to_json({'package': l_orderkey, 'part': l_partkey, 'status': l_returnflag, 'supplier': l_suppkey})::VARCHAR"
ROUTE = "sha256('[\"" + DOMAIN + "\",\"' || kind || '\",\"' || identity || '\"]')"
SNAP = f"""snap AS (SELECT *, {ROUTE} AS route, octet_length(encode(body))::BIGINT AS bytes FROM (
  SELECT 'snapshot' AS kind, o_orderkey::VARCHAR AS identity, {BODY_O} AS body, o_orderpriority AS epoch, o_orderstatus, o_custkey FROM orders))"""
OBSV = f"obs AS (SELECT 'observation' AS kind, l_orderkey || '-' || l_linenumber AS identity, {BODY_L} AS body FROM lineitem)"


# scalars


@query(f"WITH {SNAP} SELECT identity, route FROM snap")
def route_hash(spark, sf_dir):
    return snapshots(spark, sf_dir).select("identity", "route")


@query("SELECT o_orderkey::VARCHAR AS id, (('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 2))::INT // 4)::INT AS bucket FROM orders")
def bucket64(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(order_id().alias("id"), fn.bucket(order_id()).alias("bucket"))


@query(f"WITH {SNAP} SELECT identity, body FROM snap")
def canonical_json(spark, sf_dir):
    return snapshots(spark, sf_dir).select("identity", "body")


@query(
    """SELECT c_custkey, rtrim(translate(to_base64(encode(c_name)), '+/', '-_'), '=') AS text, true AS same,
              rtrim(translate(to_base64(unhex(sha256(c_name))), '+/', '-_'), '=') AS label_id FROM customer"""
)
def base64url_roundtrip(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("text", fn.base64url(F.encode("c_name", "UTF-8")))
    same = F.decode(fn.base64url_bytes(F.col("text")), "UTF-8") == F.col("c_name")
    return c.select("c_custkey", "text", same.alias("same"), fn.label_id(F.col("c_name")).alias("label_id"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'p' || o_orderkey WHEN o_orderkey % 4 = 1 THEN 'e' || o_custkey
              WHEN o_orderkey % 4 = 2 THEN 'r' || o_orderkey ELSE 'o' || o_custkey END AS identity FROM orders"""
)
def selected_identity(spark, sf_dir):
    kinds = F.array(*(F.lit(k) for k in ("snapshot", "tombstone", "root-update-receipt", "observation")))
    kind = F.get(kinds, F.pmod(F.col("o_orderkey"), F.lit(4)).cast("int"))
    of = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    picked = fn.selected_identity(kind, of("p", "o_orderkey"), of("e", "o_custkey"), of("r", "o_orderkey"), of("o", "o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", picked.alias("identity"))


@query(f"WITH {SNAP} SELECT identity, route, row_number() OVER (PARTITION BY substr(route, 1, 2) ORDER BY route, kind, identity)::BIGINT AS place FROM snap")
def route_order(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy(F.substring("route", 1, 2)).orderBy("route", "kind", "identity")
    return snapshots(spark, sf_dir).select("identity", "route", F.row_number().over(w).cast("bigint").alias("place"))


@query(f"WITH {SNAP} SELECT o_custkey AS scope, sha256('[' || string_agg(body, ',' ORDER BY identity) || ']') AS fingerprint FROM snap GROUP BY 1")
def group_fingerprint(spark, sf_dir):
    return ordered_digest(snapshots(spark, sf_dir).withColumn("scope", F.col("o_custkey")), ["scope"], [F.col("identity")], F.col("body")).drop("records")


@query("SELECT l_returnflag, l_linestatus, median(l_quantity) AS median, min(l_quantity) AS least, max(l_quantity) AS most, count(*) AS n FROM lineitem GROUP BY 1, 2")
def median_range(spark, sf_dir):
    return layout.median_range(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")


@query(
    """SELECT o_orderkey, CASE WHEN s = 401 THEN 'auth' WHEN s = 403 AND o_orderstatus = 'F' THEN 'quota' WHEN s = 403 THEN 'auth' WHEN s BETWEEN 300 AND 399 THEN 'redirect'
              WHEN o_orderstatus <> 'P' AND s >= 500 THEN 'incomplete' WHEN o_orderstatus <> 'P' THEN 'create' ELSE 'readback' END AS code
       FROM (SELECT *, [401, 403, 302, 503, 404][o_orderkey % 5 + 1] AS s FROM orders)"""
)
def classify_status(spark, sf_dir):
    status = F.get(F.array(*(F.lit(s) for s in (401, 403, 302, 503, 404))), F.pmod(F.col("o_orderkey"), F.lit(5)).cast("int"))
    reason = F.when(F.col("o_orderstatus") == "F", "storageQuotaExceeded").otherwise("other")
    return table(spark, sf_dir, "orders").select("o_orderkey", fn.classify_status(status, reason, F.col("o_orderstatus") != "P").alias("code"))


@query()
def strict_json(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    broken = F.when(F.col("event_id") % 5 == 0, F.concat("props", F.lit("}"))).when(F.col("event_id") % 7 == 0, F.concat(F.lit("﻿"), "props")).otherwise(F.col("props"))
    data = F.encode(broken, "UTF-8")
    return e.select("event_id", sj.json_refusal(data).alias("refusal"), sj.json_canonical(data).alias("canonical"))


# merge

CONF = "CASE kind WHEN 'snapshot' THEN 'snapshot-claim' ELSE 'observation-claim' END AS conflict"


@query(f"WITH {OBSV} SELECT {CONF}, identity, count(DISTINCT body) AS n_claims, string_agg(DISTINCT body, '|' ORDER BY body) AS claims FROM obs GROUP BY kind, identity HAVING count(DISTINCT body) > 1")
def identity_conflicts(spark, sf_dir):
    return merge.identity_conflicts(observations(spark, sf_dir)).withColumn("claims", F.array_join("claims", "|"))


@query(
    f"""WITH {SNAP}, {OBSV}, r AS (SELECT kind, identity, body FROM snap UNION ALL SELECT * FROM obs UNION ALL SELECT kind, identity, body FROM snap WHERE o_orderstatus = 'O')
        SELECT kind, identity, min(body) AS body FROM r GROUP BY 1, 2 HAVING count(DISTINCT body) = 1"""
)
def merged_union(spark, sf_dir):
    s = snapshots(spark, sf_dir)
    both = s.select("kind", "identity", "body").union(observations(spark, sf_dir)).union(s.where("o_orderstatus = 'O'").select("kind", "identity", "body"))
    return merge.merged_union(both)


@query("SELECT l_orderkey AS package, string_agg(s, ',' ORDER BY s) AS locators FROM (SELECT DISTINCT l_orderkey, l_suppkey AS s FROM lineitem) GROUP BY 1")
def locator_union(spark, sf_dir):
    claims = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("package"), F.array("l_suppkey").alias("locators"))
    out = merge.locator_union(claims, "package", "locators")
    return out.select("package", F.array_join(F.col("locators").cast("array<string>"), ",").alias("locators"))


REV = "rev AS (SELECT l_orderkey || '-' || l_linenumber AS revision, l_returnflag || l_linestatus AS payload FROM lineitem)"


@query(f"WITH {REV} SELECT revision, min(payload) AS payload, count(*) AS copies, min(payload) <> max(payload) AS conflict FROM rev GROUP BY 1")
def revision_dedupe(spark, sf_dir):
    return merge.revision_dedupe(table(spark, sf_dir, "lineitem").select(item_id().alias("revision"), F.concat("l_returnflag", "l_linestatus").alias("payload")))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return validate.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"WITH {SNAP} SELECT count(*) AS records, sum(bytes + 64)::BIGINT AS bytes FROM snap")
def result_budget(spark, sf_dir):
    return merge.result_budget(snapshots(spark, sf_dir))


# references


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 97 <> 0)")
def dangling_observations(spark, sf_dir):
    snaps = table(spark, sf_dir, "orders").where("o_orderkey % 97 <> 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return validate.dangling(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), snaps, "l_orderkey")


@query(
    """WITH p AS (SELECT l_orderkey, list(DISTINCT l_suppkey) AS places FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1)
       SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem JOIN p USING (l_orderkey) WHERE NOT list_contains(places, l_suppkey)"""
)
def locator_membership(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    places = items.where("l_linenumber <= 4").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("places"))
    return validate.outside_locators(items, places, "l_orderkey", "l_suppkey", "places")


OUT = """o AS (SELECT l_orderkey || '-' || l_linenumber AS identity, l_orderkey AS k, CASE l_returnflag WHEN 'A' THEN 'readback-authenticated' WHEN 'R' THEN 'digest-mismatch' ELSE 'unavailable' END AS status,
  sha256((l_orderkey + CASE WHEN l_partkey % 10 = 0 THEN 1 ELSE 0 END)::VARCHAR) AS observed, length(l_orderkey::VARCHAR) + CASE WHEN l_suppkey % 9 = 0 THEN 1 ELSE 0 END AS len FROM lineitem),
  s AS (SELECT o_orderkey AS k, sha256(o_orderkey::VARCHAR) AS digest, length(o_orderkey::VARCHAR) AS bytes FROM orders)"""


@query(
    f"""WITH {OUT} SELECT identity, rule FROM (SELECT identity, CASE WHEN status = 'readback-authenticated' AND observed <> digest THEN 'digest' WHEN status = 'readback-authenticated' AND len <> bytes THEN 'length'
        WHEN status = 'digest-mismatch' AND observed = digest THEN 'same digest' END AS rule FROM o JOIN s USING (k)) WHERE rule IS NOT NULL"""
)
def outcome_violations(spark, sf_dir):
    status = F.when(F.col("l_returnflag") == "A", "readback-authenticated").when(F.col("l_returnflag") == "R", "digest-mismatch").otherwise("unavailable")
    seen = F.col("l_orderkey") + F.when(F.col("l_partkey") % 10 == 0, 1).otherwise(0)
    length = F.length(F.col("l_orderkey").cast("string")) + F.when(F.col("l_suppkey") % 9 == 0, 1).otherwise(0)
    obs = table(spark, sf_dir, "lineitem").select(item_id().alias("identity"), F.col("l_orderkey").alias("k"), status.alias("status"), F.sha2(seen.cast("string"), 256).alias("observed"), length.alias("length"))
    snaps = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.sha2(order_id(), 256).alias("digest"), F.length(order_id()).alias("bytes"))
    return validate.outcome_violations(obs, snaps, "k")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def live_set(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return shards.live_set(o.select("o_orderkey", "o_totalprice"), o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("target")), "o_orderkey", "target")


@query(
    """WITH k AS (SELECT DISTINCT o_orderpriority AS epoch FROM orders), r AS (SELECT epoch FROM k WHERE epoch NOT LIKE '1%' UNION SELECT 'new')
       SELECT epoch, 'missing' AS side FROM k WHERE epoch NOT IN (SELECT epoch FROM r) UNION ALL SELECT epoch, 'extra' FROM r WHERE epoch NOT IN (SELECT epoch FROM k)"""
)
def epoch_cover(spark, sf_dir):
    known = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("epoch"))
    required = known.where("epoch NOT LIKE '1%'").distinct().union(spark.range(1).select(F.lit("new")))
    return validate.missing_and_extra(required, known, "epoch")


@query(
    """SELECT o_orderkey, m AS mismatches FROM (SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 11 = 0 THEN 'o_custkey' END, CASE WHEN o_orderkey % 13 = 0 THEN 'o_orderpriority' END) AS m FROM orders) WHERE m <> ''"""
)
def claim_mismatches(spark, sf_dir):
    fields = ["o_custkey", "o_orderstatus", "o_orderpriority"]
    o = table(spark, sf_dir, "orders").select("o_orderkey", *fields)
    claims = o.withColumn("o_custkey", F.when(F.col("o_orderkey") % 11 == 0, -1).otherwise(F.col("o_custkey"))).withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderpriority")))
    return validate.claim_mismatches(claims, o, "o_orderkey", fields)


@query(
    """WITH r AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS identity, l_partkey % 5 AS p1, l_suppkey % 5 AS p2, l_orderkey % 5 AS cur, l_orderkey % 4 AS o1, l_linenumber % 4 AS o2, l_partkey % 7 AS new FROM lineitem)
       SELECT 'parents repeat' AS rule, identity FROM r WHERE p1 = p2 UNION ALL SELECT 'own parent', identity FROM r WHERE cur IN (p1, p2)
       UNION ALL SELECT 'old epochs repeat', identity FROM r WHERE o1 = o2 UNION ALL SELECT 'active epoch is old', identity FROM r WHERE new IN (o1, o2)"""
)
def receipt_violations(spark, sf_dir):
    mod = lambda c, n: (F.col(c) % n).cast("bigint")
    rules = validate.receipt_rules(F.array(mod("l_partkey", 5), mod("l_suppkey", 5)), mod("l_orderkey", 5), F.array(mod("l_orderkey", 4), mod("l_linenumber", 4)), mod("l_partkey", 7))
    return validate.violations(table(spark, sf_dir, "lineitem"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), rules)


@query(
    """SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS different, count(*) FILTER (o_orderstatus = 'P') AS n_active FROM orders GROUP BY 1
       HAVING count(*) <> count(DISTINCT o_orderpriority) OR count(*) FILTER (o_orderstatus = 'P') <> 1"""
)
def one_active(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("active", F.col("o_orderstatus") == "P")
    return validate.not_one_active(o, "o_custkey", "o_orderpriority", "active")


@query(
    """WITH r AS (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN upper(sha256(event_id::VARCHAR)) ELSE sha256(event_id::VARCHAR) END AS digest,
         CASE WHEN event_id % 10 = 0 THEN '2026-02-30T00:00:00Z' WHEN event_id % 10 = 1 THEN '2026-01-02 00:00:00' ELSE '2026-01-02T03:04:05.678Z' END AS at, event_type FROM events)
       SELECT 'digest' AS rule, event_id AS identity FROM r WHERE event_id % 6 = 0 UNION ALL SELECT 'time', event_id FROM r WHERE event_id % 10 < 2 UNION ALL SELECT 'type', event_id FROM r WHERE length(event_type) > 5"""
)
def schema_violations(spark, sf_dir):
    i = F.col("event_id")
    digest = F.sha2(i.cast("string"), 256)
    at = F.when(i % 10 == 0, "2026-02-30T00:00:00Z").when(i % 10 == 1, "2026-01-02 00:00:00").otherwise("2026-01-02T03:04:05.678Z")
    rows = table(spark, sf_dir, "events").select("event_id", F.when(i % 6 == 0, F.upper(digest)).otherwise(digest).alias("digest"), at.alias("at"), "event_type")
    rules = [("digest", F.col("digest").rlike(schemas.DIGEST)), ("time", schemas.is_timestamp(F.col("at"))), ("type", F.col("event_type").rlike(schemas.PLAIN_TEXT) & (F.length("event_type") <= 5))]
    return validate.violations(rows, F.col("event_id"), rules)


# revision graph: a turn's parents are the one before and the third before; every turn 3 is missing


def _graph(spark, sf_dir, missing: bool = True) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "conversations")
    name = lambda t: F.concat_ws(":", "conv_id", t.cast("string"))
    kept = c.where("turn <> 3") if missing else c
    parents = F.explode(F.array(F.col("turn") - 1, F.col("turn") - 3))
    edges = kept.select("conv_id", "turn", parents.alias("p")).where("p >= 0").select(name(F.col("turn")).alias("child"), name(F.col("p")).alias("parent"))
    return kept.select(name(F.col("turn")).alias("node")), edges.distinct()


GRAPH = """nodes AS (SELECT conv_id || ':' || turn AS node, conv_id, turn FROM conversations WHERE turn <> 3),
  edges AS (SELECT conv_id || ':' || turn AS child, conv_id || ':' || (turn - d) AS parent FROM nodes, (VALUES (1), (3)) AS v(d) WHERE turn - d >= 0)"""
CLOSURE = """closure AS (SELECT child AS node, parent AS ancestor FROM edges UNION SELECT c.node, e.parent FROM closure c JOIN edges e ON c.ancestor = e.child)"""


@query(f"WITH {GRAPH} SELECT node FROM nodes WHERE node NOT IN (SELECT parent FROM edges)")
def revision_heads(spark, sf_dir):
    return graph.heads(*_graph(spark, sf_dir))


@query(f"WITH {GRAPH} SELECT DISTINCT parent AS node FROM edges WHERE parent NOT IN (SELECT node FROM nodes)")
def missing_parents(spark, sf_dir):
    return graph.missing_parents(*_graph(spark, sf_dir))


@query(f"WITH RECURSIVE {GRAPH}, {CLOSURE} SELECT node, ancestor FROM closure")
def ancestor_closure(spark, sf_dir):
    return graph.ancestor_closure(_graph(spark, sf_dir)[1])


TREE = """nodes AS (SELECT conv_id || ':' || turn AS node, conv_id, turn FROM conversations WHERE NOT (turn = 3 AND conv_id % 2 = 0)),
  edges AS (SELECT conv_id || ':' || turn AS child, conv_id || ':' || (turn // 2) AS parent FROM nodes WHERE turn > 0)"""


def _tree(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("NOT (turn = 3 AND conv_id % 2 = 0)")
    name = lambda t: F.concat_ws(":", "conv_id", t.cast("string"))
    nodes = c.select(name(F.col("turn")).alias("node"), "conv_id", "turn")
    return nodes, c.where("turn > 0").select(name(F.col("turn")).alias("child"), name(F.floor(F.col("turn") / 2)).alias("parent"))


HEADS = "heads AS (SELECT node, conv_id, turn FROM nodes WHERE node NOT IN (SELECT parent FROM edges)), gaps AS (SELECT DISTINCT node FROM closure WHERE ancestor NOT IN (SELECT node FROM nodes))"


@query(
    f"""WITH RECURSIVE {TREE}, {CLOSURE}, {HEADS}
        SELECT a.node AS a, b.node AS b FROM heads a JOIN heads b ON a.conv_id = b.conv_id AND a.node < b.node WHERE a.node NOT IN (SELECT node FROM gaps) AND b.node NOT IN (SELECT node FROM gaps)
        AND NOT EXISTS (SELECT 1 FROM closure c WHERE (c.node, c.ancestor) IN ((a.node, b.node), (b.node, a.node)))"""
)
def incomparable_pairs(spark, sf_dir):
    nodes, edges = _tree(spark, sf_dir)
    h = checkpoint(graph.heads(nodes, edges))
    pairs = h.select("conv_id", F.col("node").alias("a")).join(h.select("conv_id", F.col("node").alias("b")), "conv_id").where("a < b").select("a", "b")
    return graph.incomparable(pairs, graph.ancestor_closure(edges), nodes.select("node"))


@query(
    f"""WITH RECURSIVE {TREE}, {CLOSURE}, {HEADS},
        dead AS (SELECT node AS head, conv_id AS identity, 'dead' || turn AS body FROM heads WHERE turn % 2 = 0),
        live AS (SELECT node AS head, conv_id AS identity, 'live' || turn AS body FROM heads WHERE turn % 2 = 1),
        found AS (SELECT DISTINCT l.identity FROM live l JOIN dead d ON l.identity = d.identity AND l.head <> d.head WHERE l.head NOT IN (SELECT node FROM gaps) AND d.head NOT IN (SELECT node FROM gaps)
          AND NOT EXISTS (SELECT 1 FROM closure c WHERE (c.node, c.ancestor) IN ((l.head, d.head), (d.head, l.head))))
        SELECT identity, count(DISTINCT body) AS n_claims FROM (SELECT identity, body FROM live UNION SELECT identity, body FROM dead) JOIN found USING (identity) GROUP BY 1"""
)
def tombstone_live_conflicts(spark, sf_dir):
    nodes, edges = _tree(spark, sf_dir)
    h = checkpoint(graph.heads(nodes, edges))
    side = lambda r, word: h.where(F.col("turn") % 2 == r).select(F.col("node").alias("head"), F.col("conv_id").alias("identity"), F.concat(F.lit(word), F.col("turn").cast("string")).alias("body"))
    return graph.tombstone_live_conflicts(side(1, "live"), side(0, "dead"), graph.ancestor_closure(edges), nodes.select("node"))


@query(
    """WITH RECURSIVE e AS (SELECT conv_id || ':' || turn AS child, conv_id || ':' || (turn - 1) AS parent FROM conversations WHERE turn > 0
         UNION ALL SELECT conv_id || ':0', conv_id || ':2' FROM conversations WHERE turn = 2 AND conv_id % 7 = 0),
       c AS (SELECT child AS node, parent AS ancestor FROM e UNION SELECT c.node, e.parent FROM c JOIN e ON c.ancestor = e.child)
       SELECT node FROM c WHERE node = ancestor"""
)
def cycle_nodes(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    name = lambda t: F.concat_ws(":", "conv_id", t.cast("string"))
    edges = c.where("turn > 0").select(name(F.col("turn")).alias("child"), name(F.col("turn") - 1).alias("parent"))
    back = c.where("turn = 2 AND conv_id % 7 = 0").select(name(F.lit(0)).alias("child"), name(F.lit(2)).alias("parent"))
    return graph.cycle_nodes(edges.union(back))


# shards and manifest

LEAVES = f"""{SNAP}, d AS (SELECT unnest(range(0, 8)) AS d), g AS (SELECT d, substr(route, 1, d) AS prefix, count(*) AS n, sum(bytes)::BIGINT AS b FROM snap, d GROUP BY 1, 2),
  f AS (SELECT *, n = 1 OR (n <= 300 AND 84 + d + b + n <= 12000) AS fits FROM g),
  m AS (SELECT substr(s.route, 1, 7) AS deep, min(f.d) FILTER (f.fits) AS depth FROM (SELECT DISTINCT substr(route, 1, 7) AS route FROM snap) s JOIN f ON f.prefix = substr(s.route, 1, f.d) GROUP BY 1),
  found AS (SELECT DISTINCT substr(deep, 1, depth) AS prefix FROM m), inside AS (SELECT DISTINCT substr(deep, 1, d) AS prefix FROM m, d WHERE d < depth),
  below AS (SELECT prefix || substr('0123456789abcdef', i::INT, 1) AS prefix FROM inside, range(1, 17) AS r(i)),
  leaves AS (SELECT prefix, n, b AS bytes FROM found JOIN f USING (prefix) UNION ALL SELECT prefix, 0, 0 FROM below WHERE prefix NOT IN (SELECT prefix FROM found) AND prefix NOT IN (SELECT prefix FROM inside))"""


def _leaves(spark, sf_dir):
    return shards.adaptive_leaves(snapshots(spark, sf_dir), most=300, target=12_000)


@query(f"WITH {LEAVES} SELECT prefix, n, bytes FROM leaves")
def adaptive_leaves(spark, sf_dir):
    return _leaves(spark, sf_dir)


@query(
    f"""WITH {LEAVES}, p AS (SELECT prefix, rpad(prefix, 64, '0') AS s, rpad(prefix, 64, 'f') AS e FROM leaves WHERE prefix NOT LIKE '%7' UNION ALL SELECT prefix || '0', rpad(prefix, 64, '0'), rpad(prefix || '0', 64, 'f') FROM leaves WHERE prefix LIKE '%5'),
        w AS (SELECT *, lag(e) OVER o AS before, lead(s) OVER o AS after FROM p WINDOW o AS (ORDER BY s, prefix)),
        t AS (SELECT *, regexp_replace(before, 'f+$', '') AS h FROM w),
        u AS (SELECT *, rpad(substr(h, 1, length(h) - 1) || substr('0123456789abcdef', instr('0123456789abcdef', right(h, 1)) + 1, 1), 64, '0') AS nxt FROM t)
        SELECT prefix, rule FROM (SELECT prefix, CASE WHEN before IS NULL AND s <> repeat('0', 64) THEN 'first' WHEN before IS NOT NULL AND s <= before THEN 'overlap' WHEN before IS NOT NULL AND nxt <> s THEN 'gap'
          WHEN after IS NULL AND e <> repeat('f', 64) THEN 'last' END AS rule FROM u) WHERE rule IS NOT NULL"""
)
def prefix_cover(spark, sf_dir):
    leaves = checkpoint(_leaves(spark, sf_dir).select("prefix"))
    broken = leaves.where("prefix NOT LIKE '%7'").union(leaves.where("prefix LIKE '%5'").select(F.concat("prefix", F.lit("0"))))
    return shards.cover_violations(broken)


@query(f"WITH {SNAP} SELECT identity, route FROM snap WHERE NOT starts_with(route, CASE WHEN o_custkey % 50 = 0 THEN '0' ELSE substr(route, 1, 2) END)")
def prefix_membership(spark, sf_dir):
    prefix = F.when(F.col("o_custkey") % 50 == 0, F.lit("0")).otherwise(F.substring("route", 1, 2))
    return shards.misplaced(snapshots(spark, sf_dir).withColumn("prefix", prefix)).select("identity", "route")


SUMMARY = f"""{SNAP}, rec AS (SELECT kind, identity, body, route, substr(route, 1, 2) AS prefix FROM snap),
  sh AS (SELECT prefix, count(*) AS entries, 0 AS observations, sum(octet_length(encode(body)))::BIGINT AS bytes, sha256('[' || string_agg(body, ',' ORDER BY route, kind, identity) || ']') AS fingerprint FROM rec GROUP BY 1)"""


def _summary(spark, sf_dir):
    return shards.shard_summary(snapshots(spark, sf_dir).withColumn("prefix", F.substring("route", 1, 2)))


@query(
    f"""WITH {SUMMARY}, ref AS (SELECT CASE WHEN prefix = '0a' THEN 'zz' ELSE prefix END AS prefix, entries + CASE WHEN prefix LIKE '1%' THEN 1 ELSE 0 END AS entries, observations, bytes, CASE WHEN prefix LIKE '%f' THEN 'x' ELSE fingerprint END AS fingerprint FROM sh)
        SELECT prefix, rule FROM (SELECT coalesce(ref.prefix, sh.prefix) AS prefix, CASE WHEN sh.prefix IS NULL THEN 'missing' WHEN ref.prefix IS NULL THEN 'extra' WHEN ref.entries <> sh.entries THEN 'entries'
          WHEN ref.fingerprint <> sh.fingerprint THEN 'fingerprint' END AS rule FROM ref FULL JOIN sh ON ref.prefix = sh.prefix) WHERE rule IS NOT NULL"""
)
def manifest_reconcile(spark, sf_dir):
    s = _summary(spark, sf_dir)
    refs = s.select(
        F.when(F.col("prefix") == "0a", "zz").otherwise(F.col("prefix")).alias("prefix"), (F.col("entries") + F.when(F.col("prefix").like("1%"), 1).otherwise(0)).alias("entries"),
        "observations", "bytes", F.when(F.col("prefix").like("%f"), "x").otherwise(F.col("fingerprint")).alias("fingerprint"),
    )
    return shards.reconcile(refs, s)


@query(f"WITH {SUMMARY} SELECT sum(entries)::BIGINT AS entries, sum(observations)::BIGINT AS observations, sum(bytes)::BIGINT AS bytes, sum(entries) = (SELECT count(*) FROM orders) AS entries_ok, sum(observations) = 0 AS observations_ok, sum(bytes) <= 67108864 AS bytes_ok FROM sh")
def manifest_preflight(spark, sf_dir):
    return shards.preflight(_summary(spark, sf_dir), entries=table(spark, sf_dir, "orders").count(), observations=0)


@query(
    f"""WITH {SNAP} SELECT (SELECT count(*) FROM snap) AS entries, (SELECT count(*) FROM lineitem) AS observations, (SELECT count(DISTINCT epoch) FROM snap) AS epochs,
        count(*) AS live, sum(bytes)::BIGINT AS live_bytes FROM snap WHERE o_orderstatus <> 'F'"""
)
def revision_stats(spark, sf_dir):
    s = snapshots(spark, sf_dir)
    live = shards.live_set(s, s.where("o_orderstatus = 'F'").select(F.col("identity").alias("target")), "identity", "target")
    every = s.select("kind", "identity", "epoch").union(observations(spark, sf_dir).select("kind", "identity", F.lit(None).cast("string")))
    return shards.revision_stats(every, live)


@query(
    """SELECT l_orderkey, place, l_partkey FROM (SELECT l_orderkey, place, l_partkey, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY place) AS before
       FROM (SELECT l_orderkey, l_linenumber::BIGINT * 1000000000 + l_suppkey * 100000 + l_partkey AS place, l_partkey FROM lineitem)) WHERE before >= l_partkey"""
)
def order_violations(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber").cast("bigint") * 1_000_000_000 + F.col("l_suppkey") * 100_000 + F.col("l_partkey")).alias("place"), "l_partkey")
    return shards.order_violations(rows, "l_orderkey", "place", "l_partkey").drop("before")


@query(
    """SELECT o_orderkey, unnest(list_filter([CASE WHEN o_orderkey % 17 = 0 THEN 'metadata' END, CASE WHEN o_orderkey % 17 <> 0 AND o_orderkey % 5 = 1 THEN 'metadata.network.id' END,
         CASE WHEN o_orderkey % 17 <> 0 AND o_orderkey % 7 = 2 THEN 'metadata.contract' END, CASE WHEN o_orderkey % 17 <> 0 AND o_orderkey % 3 = 0 THEN 'metadata.codec.sourceCommit' END], lambda x: x IS NOT NULL)) AS path FROM orders"""
)
def expected_bindings(spark, sf_dir):
    """What is expected of each order's metadata, some members of it, against what was opened."""
    k = F.col("o_orderkey")
    text = lambda c, name: c.cast("string").alias(name)
    o = table(spark, sf_dir, "orders")
    network = lambda c: F.struct(text(c, "id"), F.lit(None).cast("string").alias("genesisHash"))
    contract = F.struct(text(F.col("o_custkey"), "address"))
    none = F.lit(None).cast("string")
    codec = F.struct(text(F.lit("c"), "id"), F.when(k % 3 == 0, "commit").otherwise(none).alias("sourceCommit"))
    had = F.struct(network(F.col("o_orderpriority")).alias("network"), F.when(k % 7 != 2, contract).alias("contract"), codec.alias("codec"), text(F.col("o_orderstatus"), "applicationId"))
    want = F.struct(network(F.when(k % 5 == 1, "other").otherwise(F.col("o_orderpriority"))).alias("network"), contract.alias("contract"), F.struct(none.alias("sourceCommit")).alias("codec"))
    opened = o.where(k % 17 != 0).select("o_orderkey", had.alias("metadata"))
    return validate.binding_mismatches(opened, o.select("o_orderkey", want.alias("metadata")), "o_orderkey")


@query(
    f"""WITH RECURSIVE {GRAPH}, {CLOSURE}, old AS (SELECT DISTINCT n.conv_id, c.ancestor FROM closure c JOIN nodes n ON n.node = c.node)
        SELECT conv_id, node, turn FROM nodes WHERE turn % 2 = 0 AND (conv_id, node) NOT IN (SELECT conv_id, ancestor FROM old)"""
)
def maximal_generations(spark, sf_dir):
    """Conversations stand for records, turns for generations; only even turns are asked for."""
    nodes, edges = _graph(spark, sf_dir)
    named = nodes.select("node", F.split("node", ":")[0].cast("bigint").alias("conv_id"), F.split("node", ":")[1].cast("bigint").alias("turn"))
    return graph.maximal_generations(named, graph.ancestor_closure(edges), "conv_id", "node", F.col("turn") % 2 == 0)


# many manifests: a customer's orders are the records of one


@query(
    f"""WITH {SNAP}, l AS (SELECT DISTINCT o_custkey AS revision, substr(route, 1, 1 + o_custkey % 2) AS prefix FROM snap),
        w AS (SELECT *, lag(rpad(prefix, 64, 'f')) OVER o AS before, lead(prefix) OVER o AS after FROM l WINDOW o AS (PARTITION BY revision ORDER BY rpad(prefix, 64, '0'), prefix)),
        t AS (SELECT *, regexp_replace(before, 'f+$', '') AS h FROM w),
        u AS (SELECT *, rpad(substr(h, 1, length(h) - 1) || substr('0123456789abcdef', instr('0123456789abcdef', right(h, 1)) + 1, 1), 64, '0') AS nxt FROM t)
        SELECT revision, prefix, rule FROM (SELECT revision, prefix, CASE WHEN before IS NULL AND rpad(prefix, 64, '0') <> repeat('0', 64) THEN 'first' WHEN before IS NOT NULL AND nxt <> rpad(prefix, 64, '0') THEN 'gap'
          WHEN after IS NULL AND rpad(prefix, 64, 'f') <> repeat('f', 64) THEN 'last' END AS rule FROM u) WHERE rule IS NOT NULL"""
)
def manifest_covers(spark, sf_dir):
    """Manifests of all customers at once, whose prefixes are those that hold records."""
    digits = F.substring(F.col("route"), F.lit(1), 1 + F.col("o_custkey").cast("int") % 2)
    leaves = snapshots(spark, sf_dir).select(F.col("o_custkey").alias("revision"), digits.alias("prefix")).distinct()
    return shards.cover_violations(leaves, group=["revision"])


@query(
    f"""WITH RECURSIVE {SNAP}, it AS (SELECT o_custkey AS revision, identity::BIGINT AS position, bytes AS length, row_number() OVER (PARTITION BY o_custkey ORDER BY identity::BIGINT) AS i FROM snap),
        walk AS (SELECT *, length AS used FROM it WHERE i = 1 UNION ALL SELECT it.*, walk.used + it.length FROM walk JOIN it ON it.revision = walk.revision AND it.i = walk.i + 1 WHERE walk.used <= 500)
        SELECT revision, position, length, used FROM walk WHERE used > 500"""
)
def shard_budget(spark, sf_dir):
    """Of each customer's orders, in turn, the first that goes over a budget of bytes."""
    s = snapshots(spark, sf_dir).select(F.col("o_custkey").alias("revision"), F.col("identity").cast("bigint").alias("position"), F.col("bytes").alias("length"))
    return shards.over_budget(s, "revision", "position", "length", 500)


#: What is wrong with a supplier's manifest, by its key.
ROOT_FLAWS = {1: ["cover: gap"], 2: ["cover: gap"], 3: ["entries"], 4: ["observations"], 5: ["reference epoch"], 6: ["reference: budget"], 7: ["reference: closed", "reference: wire digest"], 8: ["reference: locators"], 9: ["cover: last"]}


@query(
    """WITH i AS (SELECT l_suppkey AS s, substr(sha256('["'"""
    + f"|| '{DOMAIN}' ||"
    + """'","observation","' || l_orderkey || '-' || l_linenumber || '"]'), 1, 1) AS d, l_returnflag = 'R' AS entry FROM lineitem),
         t AS (SELECT s, count(*) FILTER (entry)::BIGINT AS entries, count(*) FILTER (NOT entry)::BIGINT AS observations, count(DISTINCT d) AS shards FROM i
               WHERE NOT (s % 10 = 1 AND d = '7') AND NOT (s % 10 = 9 AND d = 'f') GROUP BY s)
       SELECT s AS revision, entries, observations, (200 + CASE WHEN s % 10 = 6 THEN 300000 ELSE 0 END) * shards AS bytes, shards, CASE s % 10 """
    + " ".join(f"WHEN {k} THEN '{','.join(v)}'" for k, v in ROOT_FLAWS.items())
    + " ELSE '' END AS rules FROM t"
)
def root_preflight(spark, sf_dir):
    """Root manifests of all suppliers, as bytes: their items are the records, most have one flaw."""
    from basalt.sources import ingest

    route = fn.route_hash(F.lit("observation"), item_id())
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", F.substring(route, 1, 1).alias("d"), (F.col("l_returnflag") == "R").alias("entry"))
    full = items.groupBy("l_suppkey", "d").agg(F.count_if("entry").alias("e"), F.count_if(~F.col("entry")).alias("o"))
    flaw = F.col("l_suppkey") % 10
    every = items.select("l_suppkey").distinct().select("l_suppkey", F.explode(F.array(*(F.lit(x) for x in shards.HEX))).alias("d"))
    kept = every.join(full, ["l_suppkey", "d"], "left").where(~((flaw == 1) & (F.col("d") == "7")) & ~((flaw == 9) & (F.col("d") == "f")))
    id32, id16 = "A" * 42 + "E", "A" * 21 + "A"
    place = lambda provider: f'[{{"accountBinding":{{"scheme":"google-drive-permission-id","value":"v"}},"objectId":"o","provider":"{provider}","revisionId":null}}]'
    prefix = F.when((flaw == 2) & (F.col("d") == "7"), "70").otherwise(F.col("d"))
    held = F.format_string(
        f'{{"canonicalRecordsSha256":"{"b" * 64}","empty":false,"entryCount":%d,"generationId":"{id32}","locators":%s,"observationCount":%d,"plaintextByteLength":%d,"prefix":"%s",'
        f'"recordId":"{id32}","rootEpoch":"{id16}","wireByteLength":300%s}}',
        F.col("e"), F.when(flaw == 8, place("disk")).otherwise(place("google-drive")), F.col("o"), F.lit(200) + F.when(flaw == 6, 300_000).otherwise(0), prefix,
        F.when(flaw == 7, "").otherwise(f',"wireSha256":"{"a" * 64}"'),
    )
    text = F.when(F.col("e").isNull(), F.format_string('{"empty":true,"prefix":"%s"}', prefix)).otherwise(held)
    # at most 16 references a manifest
    roots = kept.groupBy("l_suppkey").agg(F.sum("e").alias("e"), F.sum("o").alias("o"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("d", text.alias("t")))), lambda x: x["t"]), ",").alias("refs"))
    data = F.format_string(
        '{"entryCount":%d,"nodeType":"root","observationCount":%d,"parents":[],"partitionVersion":1,"payloadVersion":2,"references":[%s],"requiredEpochs":[%s]}',
        F.col("e") + F.when(flaw == 3, 1).otherwise(0), F.col("o") + F.when(flaw == 4, 1).otherwise(0), F.col("refs"), F.when(flaw == 5, "").otherwise(f'"{id16}"'),
    )
    got = ingest.preflight_roots(roots.select(F.col("l_suppkey").alias("revision"), F.encode(data, "UTF-8").alias("data")))
    told = got.violations.groupBy("identity").agg(F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"))
    return got.totals.join(told, F.col("identity") == F.col("revision"), "left").select("revision", "entries", "observations", "bytes", "shards", F.coalesce("rules", F.lit("")).alias("rules"))


# from bytes: each order is a tombstone

DEAD = f"""dead AS (SELECT *, {ROUTE} AS route, octet_length(encode(body))::BIGINT AS bytes FROM (SELECT 'tombstone' AS kind, id AS identity, key, revision,
    '{{"body":{{"entryKind":"tombstone","eventId":"' || id || '","reason":"superseded","recordedAt":"2026-01-01T00:00:00Z","targetPackageSha256":"' || sha256(key::VARCHAR) || '"}},"recordKind":"tombstone"}}' AS body
  FROM (SELECT o_orderkey AS key, o_custkey // 10 AS revision, rtrim(translate(to_base64(unhex(sha256('event ' || o_orderkey))), '+/', '-_'), '=') AS id FROM orders)))"""


def _event(key: Column) -> Column:
    return fn.label_id(F.concat(F.lit("event "), key.cast("string")))


def _tombstone(key: Column) -> Column:
    """The canonical body of an order's tombstone."""
    start, middle = '{"entryKind":"tombstone","eventId":"', '","reason":"superseded","recordedAt":"2026-01-01T00:00:00Z","targetPackageSha256":"'
    return F.concat(F.lit(start), _event(key), F.lit(middle), F.sha2(key.cast("string"), 256), F.lit('"}'))


def _tombstones(spark, sf_dir) -> DataFrame:
    """revision, identity, route, body and record (canonical texts) of orders."""
    event, body = _event(F.col("o_orderkey")), _tombstone(F.col("o_orderkey"))
    o = table(spark, sf_dir, "orders").select(F.floor(F.col("o_custkey") / 10).alias("revision"), event.alias("identity"), body.alias("body"))
    return o.withColumns({"route": fn.route_hash(F.lit("tombstone"), F.col("identity")), "record": F.concat(F.lit('{"body":'), "body", F.lit(',"recordKind":"tombstone"}'))})


@query(
    f"""WITH {DEAD}, d AS (SELECT unnest(range(0, 8)) AS d), g AS (SELECT d, substr(route, 1, d) AS prefix, count(*) AS n, sum(bytes)::BIGINT AS b FROM dead, d GROUP BY 1, 2),
      f AS (SELECT *, n = 1 OR (n <= 300 AND 84 + d + b + n <= 60000) AS fits FROM g),
      m AS (SELECT substr(s.route, 1, 7) AS deep, min(f.d) FILTER (f.fits) AS depth FROM (SELECT DISTINCT substr(route, 1, 7) AS route FROM dead) s JOIN f ON f.prefix = substr(s.route, 1, f.d) GROUP BY 1),
      found AS (SELECT DISTINCT substr(deep, 1, depth) AS prefix FROM m), inside AS (SELECT DISTINCT substr(deep, 1, d) AS prefix FROM m, d WHERE d < depth),
      below AS (SELECT prefix || substr('0123456789abcdef', i::INT, 1) AS prefix FROM inside, range(1, 17) AS r(i)),
      t AS (SELECT prefix, count(*) AS entries, string_agg(body, ',' ORDER BY route, identity) AS r FROM found JOIN dead ON starts_with(route, prefix) GROUP BY prefix),
      p AS (SELECT *, '{{"nodeType":"shard","partitionVersion":1,"payloadVersion":2,"prefix":"' || prefix || '","records":[' || r || ']}}' AS payload FROM t)
      SELECT prefix, false AS empty, entries, octet_length(encode(payload))::BIGINT AS bytes, sha256('[' || r || ']') AS fingerprint, sha256(payload) AS payload FROM p
      UNION ALL SELECT prefix, true, NULL, NULL, NULL, NULL FROM below WHERE prefix NOT IN (SELECT prefix FROM found) AND prefix NOT IN (SELECT prefix FROM inside)"""
)
def planned_shards(spark, sf_dir):
    """Arrays of records as bytes, one for ten customers each, planned into the shards of one catalog."""
    from basalt.plans.limits import V2
    from basalt.plans.planner import plan_shards

    own = _tombstones(spark, sf_dir).groupBy("revision").agg(F.array_join(F.collect_list("record"), ",").alias("all"))
    texts = own.select(F.col("revision").cast("string").alias("revision"), F.encode(F.concat(F.lit("["), "all", F.lit("]")), "UTF-8").alias("data"))
    whole = {k: 1 << 50 for k in ("entries", "observations", "records", "references", "total_shard_bytes", "live_bytes")}  # the tables' size, not a catalog's, is the bound
    plan = plan_shards(texts, V2 | whole | {"records_per_leaf": 300, "shard_target": 60_000})
    return plan.leaves.select("prefix", "empty", "entries", "bytes", "fingerprint", F.sha2("payload", 256).alias("payload"))


@query(
    f"""WITH {DEAD}, sh AS (SELECT revision, substr(route, 1, 1) AS d, count(*) AS n FROM dead GROUP BY 1, 2),
      t AS (SELECT revision, sum(n)::BIGINT AS n, max(n) AS most, arg_min(n, d) AS first_n FROM sh GROUP BY 1)
      SELECT revision, n - CASE WHEN revision % 8 = 4 THEN first_n ELSE 0 END AS entries, CASE revision % 8 WHEN 1 THEN CASE WHEN most > 1 THEN 'manifest: fingerprint,order in a shard' ELSE '' END
        WHEN 2 THEN 'entries,entries of records' WHEN 3 THEN 'epoch,reference epoch' WHEN 4 THEN 'bytes of shards,entries of records,manifest: missing,number of shards' WHEN 5 THEN 'manifest: fingerprint'
        WHEN 6 THEN 'bytes of shards,manifest: bytes' WHEN 7 THEN 'bytes of shards,manifest: bytes,over budget' ELSE '' END AS rules FROM t WHERE n > CASE WHEN revision % 8 = 4 THEN first_n ELSE 0 END"""
)
def revision_rules(spark, sf_dir):
    """Roots and shards of many revisions as bytes, one for ten customers each, most with one flaw."""
    from basalt.plans.planner import shard_text
    from basalt.plans.revision import validate_revisions

    flaw = F.col("revision") % 8
    t = _tombstones(spark, sf_dir).withColumn("d", F.substring("route", 1, 1))
    rows = F.array_sort(F.collect_list(F.struct("route", "identity", "record")))  # some records of ten customers
    text = lambda rows: F.array_join(F.transform(rows, lambda x: x["record"]), ",")
    own = t.groupBy("revision", "d").agg(F.count("*").alias("n"), text(rows).alias("r"), text(F.reverse(rows)).alias("back"))
    own = checkpoint(own.withColumn("payload", shard_text(F.col("d"), F.when(flaw == 1, F.col("back")).otherwise(F.col("r")))))
    id32, id16 = "A" * 42 + "E", "A" * 21 + "A"
    place = '[{"accountBinding":{"scheme":"google-drive-permission-id","value":"v"},"objectId":"o","provider":"google-drive","revisionId":null}]'
    length = F.octet_length(F.encode("payload", "UTF-8")) + F.when(flaw == 6, 1).when(flaw == 7, -1).otherwise(0)
    held = F.format_string(
        f'{{"canonicalRecordsSha256":"%s","empty":false,"entryCount":%d,"generationId":"{id32}","locators":{place},"observationCount":0,"plaintextByteLength":%d,"prefix":"%s",'
        f'"recordId":"{id32}","rootEpoch":"{id16}","wireByteLength":300,"wireSha256":"{"a" * 64}"}}',
        F.when(flaw == 5, F.lit("b" * 64)).otherwise(F.sha2(F.concat(F.lit("["), "r", F.lit("]")), 256)), F.col("n"), length, F.col("d"),
    )
    every = own.select("revision").distinct().select("revision", F.explode(F.array(*(F.lit(x) for x in shards.HEX))).alias("d"))
    refs = every.join(own.select("revision", "d", "n", held.alias("ref")), ["revision", "d"], "left").withColumn("ref", F.coalesce("ref", F.format_string('{"empty":true,"prefix":"%s"}', "d")))
    roots = refs.groupBy("revision").agg(F.sum("n").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("d", "ref"))), lambda x: x["ref"]), ",").alias("refs"))
    data = F.format_string(
        '{"entryCount":%d,"nodeType":"root","observationCount":0,"parents":[],"partitionVersion":1,"payloadVersion":2,"references":[%s],"requiredEpochs":[%s]}',
        F.col("n") + F.when(flaw == 2, 1).otherwise(0), F.col("refs"), F.when(flaw == 3, "").otherwise(f'"{id16}"'),
    )
    lowest = own.groupBy("revision").agg(F.min("d").alias("lowest"))
    sent = own.join(lowest, "revision").where(~((flaw == 4) & (F.col("d") == F.col("lowest"))))
    nodes = sent.select("revision", F.conv("d", 16, 10).cast("int").alias("position"), F.encode("payload", "UTF-8").alias("data"))
    got = validate_revisions(roots.select("revision", F.encode(data, "UTF-8").alias("data")), nodes)
    told = got.violations.groupBy("identity").agg(F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"))
    return got.totals.join(told, F.col("identity") == F.col("revision"), "left").select("revision", "entries", F.coalesce("rules", F.lit("")).alias("rules"))


@query(
    """WITH o AS (SELECT o_orderkey AS key, rtrim(translate(to_base64(unhex(sha256('event ' || o_orderkey))), '+/', '-_'), '=') AS identity FROM orders),
         c AS (SELECT identity, '{"entryKind":"tombstone","eventId":"' || identity || '","reason":"' || reason || '","recordedAt":"2026-01-01T00:00:00Z","targetPackageSha256":"' || sha256(key::VARCHAR) || '"}' AS body
               FROM o, (VALUES ('superseded'), ('user-request')) v(reason) WHERE reason = 'superseded' OR key % 9 = 0)
       SELECT identity, CASE WHEN count(*) > 1 THEN 'event-claim' END AS conflict, string_agg(body, '|' ORDER BY body) AS claims FROM c GROUP BY 1"""
)
def reconcile_catalogs(spark, sf_dir):
    """Catalogs as bytes, one for ten customers each, and a later revision of each that claims something else of every ninth order."""
    from basalt.plans.limits import V1
    from basalt.plans.reconcile import reconcile_catalogs as reconcile_bytes

    # numbers of orders are gathered, and bodies made of them where they are
    own = spread(table(spark, sf_dir, "orders").select(F.floor(F.col("o_custkey") / 10).alias("revision"), "o_orderkey"), "revision")
    own = own.groupBy("revision").agg(F.collect_list("o_orderkey").alias("keys"))
    own = own.select("revision", F.transform("keys", lambda k: F.struct((k % 9 == 0).alias("again"), _tombstone(k).alias("body"))).alias("r"))
    later = lambda x: F.when(x["again"], F.replace(x["body"], F.lit('"superseded"'), F.lit('"user-request"'))).otherwise(x["body"])
    name = lambda which: F.sha2(F.concat(F.lit(which), F.col("revision").cast("string")), 256)
    text = lambda all_, *parents: F.encode(F.concat(F.lit('{"payloadVersion":1,"parents":['), *parents, F.lit('],"entries":['), F.array_join(all_, ","), F.lit('],"observations":[]}')), "UTF-8")
    first = F.struct(name("first").alias("revision"), text(F.transform("r", lambda x: x["body"])).alias("data"))
    second = F.struct(name("second").alias("revision"), text(F.transform("r", later), F.lit('"'), name("first"), F.lit('"')).alias("data"))
    texts = own.select(F.inline(F.array(first, second)))
    # the tables' size, not a catalog's, is the bound
    got = reconcile_bytes(written(texts, "texts"), V1 | {k: 1 << 30 for k in ("inputs", "entries", "observations", "parents")} | {"result_bytes": 1 << 50})
    agreed = got.union.select("identity", F.lit(None).cast("string").alias("conflict"), F.col("body").alias("claims"))
    return agreed.union(got.conflicts.select("identity", "conflict", F.array_join("claims", "|")))


# layouts: events as two revisions of records


def _revisions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("payload"), "user_id")
    parent = e.select("id", "payload")
    child = e.select("id", F.when(F.col("user_id") % 40 == 0, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")).alias("payload"))
    return parent, child


BUCKET = "(('0x' || substr(sha256(id), 1, 2))::INT // 4)::INT"
REVS = f"""parent AS (SELECT event_id::VARCHAR AS id, event_type AS payload FROM events), child AS (SELECT event_id::VARCHAR AS id, CASE WHEN user_id % 40 = 0 THEN event_type || '!' ELSE event_type END AS payload FROM events),
  pp AS (SELECT {BUCKET} AS bucket, count(*) AS records, sha256('[' || string_agg(payload, ',' ORDER BY id) || ']') AS fingerprint FROM parent GROUP BY 1),
  cp AS (SELECT {BUCKET} AS bucket, count(*) AS records, sha256('[' || string_agg(payload, ',' ORDER BY id) || ']') AS fingerprint FROM child GROUP BY 1)"""
STATE = "CASE WHEN pp.fingerprint IS NULL THEN 'added' WHEN cp.fingerprint IS NULL THEN 'removed' WHEN pp.fingerprint = cp.fingerprint THEN 'reused' ELSE 'changed' END"


@query(f"WITH {REVS} SELECT coalesce(pp.bucket, cp.bucket) AS bucket, {STATE} AS state FROM pp FULL JOIN cp ON pp.bucket = cp.bucket")
def changed_buckets(spark, sf_dir):
    return layout.changed_buckets(*(layout.bucket_prints(r) for r in _revisions(spark, sf_dir)))


@query(f"WITH {REVS} SELECT cp.bucket, cp.records, cp.fingerprint, {STATE} AS state FROM cp LEFT JOIN pp ON pp.bucket = cp.bucket")
def sharded_commit(spark, sf_dir):
    """Both revisions written, the second beside the first with changed buckets only, and its manifest read back."""
    parent, child = _revisions(spark, sf_dir)
    a, b = scratch(spark, "revision-a"), scratch(spark, "revision-b")
    layout.write_sharded(parent, a)
    layout.write_sharded(child, b, a)
    old = F.when(F.col("place") == a, "reused").otherwise("changed")
    return spark.read.parquet(f"{b}/manifest").select("bucket", "records", "fingerprint", old.alias("state"))


@query(f"WITH {REVS} SELECT id, payload, {BUCKET} AS bucket FROM child")
def restore_sharded(spark, sf_dir):
    parent, child = _revisions(spark, sf_dir)
    a, b = scratch(spark, "revision-a"), scratch(spark, "revision-b")
    layout.write_sharded(parent, a)
    layout.write_sharded(child, b, a)
    back = layout.read_sharded(spark, b)
    validate.enforce(layout.misplaced(back).select(F.lit("bucket").alias("rule"), F.col("id").alias("identity")), "reference")
    return back


@query(f"WITH {REVS} SELECT count(*) AS records, sha256('[' || string_agg(payload, ',' ORDER BY id) || ']') AS fingerprint, false AS no_change FROM child")
def flat_commit(spark, sf_dir):
    return layout.flat_commit(*_revisions(spark, sf_dir))


@query(f"WITH {REVS} SELECT id, payload FROM child WHERE {BUCKET} <> CASE WHEN payload LIKE '%!' THEN 7 ELSE {BUCKET} END")
def bucket_membership(spark, sf_dir):
    c = layout.bucketed(_revisions(spark, sf_dir)[1])
    return layout.misplaced(c.withColumn("bucket", F.when(F.col("payload").like("%!"), 7).otherwise(F.col("bucket")))).select("id", "payload")


@query(f"WITH {REVS} SELECT id, payload FROM parent WHERE id = '77'")
def pruned_lookup(spark, sf_dir):
    path = scratch(spark, "buckets")
    layout.bucketed(_revisions(spark, sf_dir)[0]).write.mode("overwrite").partitionBy("bucket").parquet(path)
    return layout.pruned_lookup(spark.read.parquet(path), "77").select("id", "payload")


@query(f"WITH {REVS} SELECT *, 'left' AS side FROM (SELECT * FROM parent EXCEPT ALL SELECT * FROM child) UNION ALL SELECT *, 'right' FROM (SELECT * FROM child EXCEPT ALL SELECT * FROM parent)")
def logical_equal(spark, sf_dir):
    return layout.differences(*_revisions(spark, sf_dir))


@query(
    """WITH n AS (SELECT i AS n, 'rec-' || lpad(i::VARCHAR, 8, '0') AS id FROM range(5000) AS r(i)), w AS (SELECT *, 128 + ('0x' || substr(sha256('seed:' || id), 1, 2))::INT % 129 AS width, '{"k":"seed","n":' || n || ',"pad":"' AS head FROM n)
       SELECT id, head || repeat('A', greatest(0, width - length(head) - 2)::INT) || '"}' AS payload FROM w"""
)
def synthetic_records(spark, sf_dir):
    return layout.synthetic_records(spark, 5000, "seed")


@query("SELECT event_id::VARCHAR AS id, CASE WHEN event_id = 42 THEN 'updated' ELSE event_type END AS payload FROM events")
def apply_update(spark, sf_dir):
    return layout.apply_update(_revisions(spark, sf_dir)[0], "42", F.lit("updated"))


@query("SELECT event_type AS op, CASE WHEN user_id % 3 = 0 THEN 'data' ELSE 'manifest' END AS role, count(*) AS calls, sum(event_id)::BIGINT AS bytes FROM events GROUP BY 1, 2")
def store_counters(spark, sf_dir):
    role = F.when(F.col("user_id") % 3 == 0, "data").otherwise("manifest")
    return layout.store_counters(table(spark, sf_dir, "events").select(F.col("event_type").alias("op"), role.alias("role"), F.col("event_id").alias("bytes")))


@query(
    """SELECT o_custkey, median(o_orderkey) AS median, min(o_orderkey) AS least, max(o_orderkey) AS most, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS observed, bool_and(o_orderstatus = 'O') AS all_equal FROM orders GROUP BY 1"""
)
def trial_summary(spark, sf_dir):
    t = table(spark, sf_dir, "orders").withColumn("equal", F.col("o_orderstatus") == "O")
    return layout.trial_summary(t, ["o_custkey"], "o_orderkey", "equal")


# packs: the orders of one customer are the shards of a revision

PACKED = f"""{SNAP}, it AS (SELECT o_custkey AS grp, identity::BIGINT AS shard, bytes, row_number() OVER (PARTITION BY o_custkey ORDER BY identity::BIGINT) AS i FROM snap),
  pk AS (SELECT grp, shard, bytes, i, 0 AS pack, 0::BIGINT AS off FROM it WHERE i = 1 UNION ALL
    SELECT it.grp, it.shard, it.bytes, it.i, CASE WHEN pk.off + pk.bytes + it.bytes > 200 THEN pk.pack + 1 ELSE pk.pack END, CASE WHEN pk.off + pk.bytes + it.bytes > 200 THEN 0 ELSE pk.off + pk.bytes END FROM pk JOIN it ON it.grp = pk.grp AND it.i = pk.i + 1)"""


def _pieces(spark, sf_dir):
    s = snapshots(spark, sf_dir).select(F.col("o_custkey").alias("group"), F.col("identity").cast("bigint").alias("shard"), F.col("bytes").alias("length"), "body")
    return s, packs.greedy_pack(s, "group", "shard", "length", target=200)


@query(f"WITH RECURSIVE {PACKED} SELECT grp AS \"group\", shard, bytes AS length, pack, off AS \"offset\" FROM pk")
def greedy_pack(spark, sf_dir):
    return _pieces(spark, sf_dir)[1]


@query(
    f"""WITH RECURSIVE {PACKED}, x AS (SELECT grp, pack, shard, off, bytes + CASE WHEN shard % 9 = 0 THEN 5 ELSE 0 END AS len FROM pk)
        SELECT grp AS "group", pack, shard FROM (SELECT *, max(off + len) OVER (PARTITION BY grp, pack ORDER BY off, shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x) WHERE off < before"""
)
def extent_overlaps(spark, sf_dir):
    x = _pieces(spark, sf_dir)[1].withColumn("length", F.col("length") + F.when(F.col("shard") % 9 == 0, 5).otherwise(0))
    return packs.extent_overlaps(x, ["group", "pack"]).select("group", "pack", "shard")


@query(f"WITH RECURSIVE {PACKED} SELECT grp AS \"group\", pack, shard, shard % 9 <> 0 AS ok FROM pk")
def unpack_extents(spark, sf_dir):
    """Packs built, then cut again by extents of which every ninth is shifted by a byte."""
    s, x = _pieces(spark, sf_dir)
    whole = x.join(s.select("group", "shard", "body"), ["group", "shard"])
    data = packs.build_packs(whole.select("group", "pack", "offset", F.encode("body", "UTF-8").alias("data")))
    off = F.col("offset") + F.when(F.col("shard") % 9 == 0, 1).otherwise(0)
    extents = whole.select("group", "pack", "shard", off.alias("offset"), "length", F.sha2("body", 256).alias("hash"))
    return packs.unpack(extents, data).select("group", "pack", "shard", "ok")


@query("SELECT doc_id, CASE WHEN 50 + 20 <= octet_length(encode(text)) THEN sha256(array_slice(encode(text), 51, 70)) END AS part FROM documents")
def range_get(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    return packs.range_get(d, "data", F.lit(50), F.lit(20)).select("doc_id", F.sha2("part", 256).alias("part"))


# store


@query("SELECT sha256(text) AS sha256, min(octet_length(encode(text)))::BIGINT AS bytes FROM documents GROUP BY 1")
def journal_put(spark, sf_dir):
    """Two overlapping puts: half the documents, then all."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data")).withColumn("sha256", F.sha2("data", 256))
    path = scratch(spark, "journal") + "/objects"
    store.put(spark, path, d.where("doc_id % 2 = 0").select("sha256", "data"))
    store.put(spark, path, d.select("sha256", "data"))
    return store.read(spark, path).select("sha256", F.octet_length("data").cast("bigint").alias("bytes"))


@query(
    """SELECT event_id::VARCHAR AS id, CASE WHEN user_id % 40 = 0 THEN event_type || '!' ELSE event_type END AS second, CASE WHEN event_id % 7 <> 0 THEN CASE WHEN user_id % 40 = 0 THEN event_type || '!' ELSE event_type END END AS third FROM events"""
)
def object_versions(spark, sf_dir):
    """All events put, some replaced, then some deleted; readers of the second version and of the third."""
    from basalt.sources.versions import ObjectLog

    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_id").cast("string").alias("key"), F.lit("data").alias("role"), F.encode("event_type", "UTF-8").alias("data"))
    log = ObjectLog(spark, scratch(spark, "objects"))
    log.put(e)
    log.replace(e.where("user_id % 40 = 0").withColumn("data", F.concat("data", F.encode(F.lit("!"), "UTF-8"))))
    second = log.open()
    log.delete(e.where("event_id % 7 = 0"))
    text = lambda s, name: s.objects().select("key", F.decode("data", "UTF-8").alias(name))
    return text(second, "second").join(text(log.open(), "third").hint("merge"), "key", "left").withColumnRenamed("key", "id")


@query("SELECT DISTINCT sha256(l_orderkey::VARCHAR) AS sha256 FROM lineitem WHERE l_orderkey % 20 <> 0")
def journal_list(spark, sf_dir):
    i = F.col("l_orderkey")
    name = F.when(i % 20 == 0, F.concat(F.lit(".tmp-"), F.hex(i).substr(1, 8))).otherwise(F.concat(F.sha2(i.cast("string"), 256), F.lit(".pkg")))
    names = table(spark, sf_dir, "lineitem").select(F.lower(name).alias("name")).distinct()
    return store.list_digests(names, most=None)


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'absent' WHEN o_orderkey % 10 = 1 THEN 'length' WHEN o_orderkey % 10 = 2 THEN 'digest' ELSE 'verified' END AS state FROM orders"""
)
def readback_verify(spark, sf_dir):
    i = F.col("o_orderkey")
    sent = table(spark, sf_dir, "orders").select("o_orderkey", F.sha2(order_id(), 256).alias("sha256"), F.length(order_id()).alias("bytes"))
    back = sent.where(i % 10 != 0).select("o_orderkey", F.when(i % 10 == 2, "x").otherwise(F.col("sha256")).alias("sha256"), (F.col("bytes") + F.when(i % 10 == 1, 1).otherwise(0)).alias("bytes"))
    return store.readback(sent, back, "o_orderkey")


@query(
    """WITH p AS (SELECT 'https://h.test' || rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') AS url, sha256(html) AS sha256, octet_length(encode(html))::BIGINT AS bytes, len(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1)))::BIGINT AS links FROM pages),
       r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY sha256) AS i FROM p) SELECT url, sha256, bytes, links FROM r WHERE i = 1"""
)
def page_manifest(spark, sf_dir):
    url = F.regexp_replace("url", "^[a-z]+://[^/?#]*", "https://h.test")
    return store.page_manifest(table(spark, sf_dir, "pages"), fn.canonical_url(url, ("h.test",)), F.col("html"))


@query(
    """SELECT c_custkey, CASE c_custkey % 7 WHEN 1 THEN 'authentication' WHEN 2 THEN 'authentication' WHEN 3 THEN 'epoch' WHEN 4 THEN 'closed' END AS failure,
              CASE WHEN c_custkey % 7 NOT IN (1, 2, 3, 4) THEN sha256('{"name":"' || c_name || '"}') END AS payload FROM customer"""
)
def sealed_packages(spark, sf_dir):
    """Customers sealed and opened again; of some the tag or a header's record is changed, the epoch unknown, or a member added."""
    from basalt.sources import packages

    k = F.col("c_custkey")
    id32 = lambda c: fn.base64url(F.unhex(F.sha2(c, 256)))
    name = k.cast("string")
    epoch = F.when(k % 7 == 3, "B" * 21 + "A").otherwise("A" * 22)
    header = F.struct(
        F.lit("A" * 22).alias("vaultId"), id32(F.lit("salt")).alias("vaultSalt"), epoch.alias("rootEpoch"), id32(F.lit("scope")).alias("scopeId"), id32(F.concat(F.lit("record "), name)).alias("recordId"),
        id32(F.concat(F.lit("generation "), name)).alias("generationId"), F.lit("snapshot").alias("kind"), fn.base64url(F.substring(F.unhex(F.sha2(name, 256)), 1, 12)).alias("nonce"),
    )
    payload = F.encode(fn.canonical_json(F.struct(F.col("c_name").alias("name"))), "UTF-8")
    secret = F.unhex(F.sha2(F.lit("secret"), 256)).alias("secret")
    # cut here and below, or each member of a header would be worked out again wherever it is used
    given = checkpoint(spread(table(spark, sf_dir, "customer"), "c_custkey").select(name.alias("name"), payload.alias("payload"), header.alias("header"), secret))
    sealed = packages.seal_packages(given)
    i, text = F.col("name").cast("bigint") % 7, F.col("wire").cast("string")
    tag = F.regexp_replace(text, '"tag":"[^"]*"', '"tag":"' + "A" * 22 + '"')
    record = F.regexp_replace(text, '"recordId":"[^"]*"', '"recordId":"' + "A" * 43 + '"')
    text = F.when(i == 1, tag).when(i == 2, record).when(i == 4, F.replace(text, F.lit('"tag":'), F.lit('"a":0,"tag":'))).otherwise(text)
    kept, broken = packages.parse_packages(checkpoint(sealed.select("name", F.encode(text, "UTF-8").alias("wire"))))
    opened = packages.open_packages(checkpoint(kept), spark.range(1).select(F.lit("A" * 22).alias("epoch"), secret))
    out = opened.select("name", "failure", F.sha2("payload", 256).alias("payload")).union(broken.select("identity", "rule", F.lit(None).cast("string")))
    return out.select(F.col("name").cast("bigint").alias("c_custkey"), "failure", "payload")


# end to end


@query(
    f"""WITH {OBSV}, {GRAPH}, u AS (SELECT identity, count(DISTINCT body) AS n FROM obs GROUP BY 1)
        SELECT (SELECT count(*) FROM nodes)::BIGINT AS revisions, (SELECT count(*) FROM nodes WHERE node NOT IN (SELECT parent FROM edges))::BIGINT AS heads,
          (SELECT count(DISTINCT parent) FROM edges WHERE parent NOT IN (SELECT node FROM nodes))::BIGINT AS missing_parents, count(*) FILTER (n = 1)::BIGINT AS agreed, count(*) FILTER (n > 1)::BIGINT AS conflicts,
          count(*) FILTER (n > 1) = 0 AS whole, 'unknown' AS freshness FROM u"""
)
def reconcile_summary(spark, sf_dir):
    from basalt.plans.reconcile import reconcile

    nodes, edges = _graph(spark, sf_dir)
    return reconcile(observations(spark, sf_dir), nodes, edges).summary()


# claims, records, extents and lookups


@query(
    """WITH r AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, 'a' || (o_orderkey % 3) AS l FROM orders
         UNION ALL SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END, 'b' || (o_orderkey % 2) FROM orders
         UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, 'a' || (o_orderkey % 2) FROM orders),
       v AS (SELECT k, '{"custkey":' || c || ',"locators":[' || string_agg(DISTINCT '{"accountBinding":{"scheme":"s","value":"v"},"objectId":"' || l || '","provider":"p","revisionId":null}', ','
             ORDER BY '{"accountBinding":{"scheme":"s","value":"v"},"objectId":"' || l || '","provider":"p","revisionId":null}') || '],"status":"' || s || '"}' AS body FROM r GROUP BY k, c, s)
       SELECT k::VARCHAR AS identity, count(*) AS n_claims, string_agg(body, '|' ORDER BY body) AS claims FROM v GROUP BY 1"""
)
def snapshot_claims(spark, sf_dir):
    """Three revisions that agree on a snapshot or not, and name places of their own."""
    k = F.col("o_orderkey")
    place = lambda c: F.struct(F.struct(F.lit("s").alias("scheme"), F.lit("v").alias("value")).alias("accountBinding"), c.alias("objectId"), F.lit("p").alias("provider"), F.lit(None).cast("string").alias("revisionId"))
    named = lambda prefix, by: F.concat(F.lit(prefix), (k % by).cast("string"))
    orders, out = table(spark, sf_dir, "orders"), None
    for at, status in ((named("a", 3), F.col("o_orderstatus")), (named("b", 2), F.when(k % 5 == 0, "X").otherwise(F.col("o_orderstatus"))), (named("a", 2), F.col("o_orderstatus"))):
        body = fn.canonical_json(F.struct(F.col("o_custkey").alias("custkey"), F.array(place(at)).alias("locators"), status.alias("status")))
        own = orders.select(F.lit("snapshot").alias("kind"), order_id().alias("identity"), body.alias("body"))
        out = own if out is None else out.union(own)
    return merge.claim_views(out).groupBy("identity").agg(F.count("*").alias("n_claims"), F.array_join(F.array_sort(F.collect_list("body")), "|").alias("claims"))


BROKEN = {1: ["closed"], 2: ["reason"], 3: ["target digest"], 4: ["closed", "recorded at"], 5: ["event id"], 6: ["closed", "entry kind"]}


@query(
    "SELECT o_orderkey::VARCHAR AS identity, unnest(CASE o_orderkey % 8 "
    + " ".join(f"WHEN {k} THEN {v!r}" for k, v in BROKEN.items())
    + " ELSE []::VARCHAR[] END) AS rule FROM orders"
)
def record_violations(spark, sf_dir):
    """Tombstones of orders, most of them with one thing wrong."""
    i = F.col("o_orderkey") % 8
    sha = F.when(i == 3, F.upper(F.sha2(order_id(), 256))).otherwise(F.sha2(order_id(), 256))
    member = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    parts = [
        member("entryKind", F.when(i == 6, F.lit("7")).otherwise(F.lit('"tombstone"'))),
        member("eventId", text(F.when(i == 5, "short").otherwise(F.concat(F.lit("A" * 42), F.lit("E"))))),
        member("reason", text(F.when(i == 2, "other").otherwise("superseded"))),
        member("recordedAt", F.when(i == 4, F.lit("5")).otherwise(F.lit('"2026-01-01T00:00:00Z"'))),
        member("targetPackageSha256", text(sha)),
        F.when(i == 1, F.lit('"zone":1')),
    ]
    body = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    rows = table(spark, sf_dir, "orders").select(F.lit("tombstone").alias("kind"), order_id().alias("identity"), body.alias("body"))
    return records.record_violations(rows).select("identity", "rule")


#: What is wrong with the snapshot of an order, by its key: a member, the JSON it has instead (null: it is absent), and the rules broken.
FLAWS = [
    ("label", None, ["closed"]),
    ("label", '"\\n"', ["label"]),
    ("label", "null", []),
    ("revisionId", None, ["closed"]),
    ("revisionId", '"a/b "', ["locators"]),
    ("genesisHash", None, ["closed"]),
    ("genesisHash", '"' + "g" * 257 + '"', ["metadata"]),
    ("id", '""', ["metadata"]),
    ("retentionClass", '"standard"', ["metadata"]),
    ("retentionClass", '"irreplaceable-private-state\\n"', ["metadata"]),
    ("parents", "[" + ",".join(f'"{i:064x}"' for i in range(17)) + "]", ["metadata parents"]),
    ("parents", "[" + ",".join(f'"{i:064x}"' for i in range(16)) + "]", []),
    ("privateStateIds", None, ["closed", "private states"]),
    ("privateStateIds", "[]", ["private states"]),
    ("privateStateIds", "[" + ",".join(f'"{i}"' for i in range(300)) + "]", ["private states"]),
    ("sourceCommit", "null", ["codec"]),
    ("sourceCommit", '"' + "c" * 40 + '\\n"', ["codec"]),
    ("value", '""', ["metadata", "locators"]),
    ("transactionId", '""', ["lifecycle"]),
    ("version", "2147483648", ["codec"]),
    ("byteLength", '"3"', ["closed", "package bytes"]),
    ("zone", "null", ["closed"]),
    ("zone", None, []),
]


@query(
    f"SELECT o_orderkey::VARCHAR AS identity, unnest(CASE o_orderkey % {len(FLAWS)} "
    + " ".join(f"WHEN {k} THEN {v}::VARCHAR[]" for k, (*_, v) in enumerate(FLAWS))
    + " END) AS rule FROM orders"
)
def snapshot_violations(spark, sf_dir):
    """Whole snapshots of orders, most of them with one member wrong at some depth."""
    at = (F.col("o_orderkey") % len(FLAWS)).cast("int")
    sha = F.concat(F.lit('"'), F.sha2(order_id(), 256), F.lit('"'))
    id32, id16 = '"' + "A" * 42 + 'E"', '"' + "A" * 21 + 'A"'

    def member(name: str, fine) -> Column:
        """The member's text and a comma, as its order has it; ``fine`` is JSON or a column of it."""
        text = F.lit(fine) if isinstance(fine, str) else fine
        for k, (which, instead, _) in enumerate(FLAWS):
            if which == name:
                text = F.when(at == k, F.lit(instead)).otherwise(text)
        return F.coalesce(F.concat(F.lit(f'"{name}":'), text, F.lit(",")), F.lit(""))

    def members(*each) -> Column:
        """An object of members in sorted order."""
        return F.concat(F.lit("{"), F.rtrim(F.concat(*each), F.lit(",")), F.lit("}"))

    account = members(member("scheme", '"s"'), member("value", '"v"'))
    codec = members(*(member(*m) for m in (("codecId", '"c"'), ("producerPackage", '"p"'), ("producerVersion", '"1"'), ("sourceCommit", '"' + "c" * 40 + '"'), ("version", "1"))))
    codec = F.replace(codec, F.lit('"codecId"'), F.lit('"id"'))
    metadata = members(
        member("accountBinding", account), member("applicationId", '"app"'), member("capturedAt", '"2026-01-01T00:00:00Z"'), member("codec", codec),
        member("contract", '{"address":"x","codeHash":null}'), member("lifecycle", members(member("blockHash", "null"), member("status", '"confirmed"'), member("transactionId", "null"))),
        member("network", members(member("genesisHash", "null"), member("id", '"n"'))), member("parents", "[]"), member("privateStateIds", '["p"]'), member("retentionClass", '"retained-application-witness"'),
    )
    place = members(member("accountBinding", account), member("objectId", '"o"'), member("provider", '"google-drive"'), member("revisionId", "null"))
    package = members(member("byteLength", "3"), member("generationId", id32), member("recordId", id32), member("rootEpoch", id16), member("scopeId", id32), member("sha256", sha))
    none = F.lit(None).cast("string")
    body = members(member("entryKind", '"snapshot"'), member("label", '"order"'), member("locators", F.concat(F.lit("["), place, F.lit("]"))), member("metadata", metadata), member("package", package), member("zone", none))
    rows = table(spark, sf_dir, "orders").select(F.lit("snapshot").alias("kind"), order_id().alias("identity"), body.alias("body"))
    return records.record_violations(rows).select("identity", "rule")


@query("SELECT o_orderkey::VARCHAR AS identity, CASE WHEN o_orderkey % 2 = 0 THEN 'snapshot' ELSE 'observation' END AS kind FROM orders WHERE o_orderkey % 6 IN (3, 4)")
def kind_mismatches(spark, sf_dir):
    i = F.col("o_orderkey")
    kind = F.when(i % 2 == 0, "snapshot").otherwise("observation")
    named = F.when(i % 6 == 4, "tombstone").when((i % 2 == 0) | (i % 6 == 3), "snapshot")
    rows = table(spark, sf_dir, "orders").select(kind.alias("kind"), order_id().alias("identity"), F.to_json(F.struct(named.alias("entryKind"))).alias("body"))
    return records.kind_mismatches(rows).select("identity", "kind")


@query(
    f"""WITH RECURSIVE {PACKED}, x AS (SELECT grp, pack, shard, off - CASE WHEN shard % 11 = 0 THEN 1000000 ELSE 0 END AS off, bytes + CASE WHEN shard % 9 = 0 THEN 5 ELSE 0 END AS len, shard % 7 = 0 AS bad FROM pk),
        o AS (SELECT *, max(off + len) OVER (PARTITION BY grp, pack ORDER BY off, shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x)
        SELECT 'bounds' AS rule, grp AS "group", shard FROM x WHERE off < 0 UNION ALL SELECT 'hash', grp, shard FROM x WHERE bad UNION ALL SELECT 'overlap', grp, shard FROM o WHERE off < before"""
)
def extent_violations(spark, sf_dir):
    s = F.col("shard")
    x = _pieces(spark, sf_dir)[1].withColumn("length", F.col("length") + F.when(s % 9 == 0, 5).otherwise(0)).withColumn("offset", F.col("offset") - F.when(s % 11 == 0, 1_000_000).otherwise(0))
    x = x.withColumn("pack_hash", F.sha2(F.col("pack").cast("string"), 256)).withColumn("hash", F.when(s % 7 == 0, "x").otherwise(F.sha2(s.cast("string"), 256)))
    return packs.extent_violations(x).select("rule", "group", "shard")


@query(f"WITH RECURSIVE {PACKED} SELECT grp AS \"group\", shard, pack, bytes AS length, off AS \"offset\" FROM pk WHERE shard = (SELECT min(o_orderkey) FROM orders)")
def single_extent(spark, sf_dir):
    first = table(spark, sf_dir, "orders").agg(F.min("o_orderkey")).first()[0]
    return packs.single_extent(_pieces(spark, sf_dir)[1], first).select("group", "shard", "pack", "length", "offset")


@query("SELECT event_id::VARCHAR AS id, event_type FROM events WHERE event_id = (SELECT max(event_id) FROM events)")
def flat_lookup(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    last = e.agg(F.max("event_id")).first()[0]
    return layout.flat_lookup(e.select(F.col("event_id").cast("string").alias("id"), "event_type"), str(last))


@query("SELECT n_nationkey, n_regionkey AS epoch, r_name AS name, n_regionkey = 3 AS active FROM nation JOIN region ON r_regionkey = n_regionkey")
def epoch_lookup(spark, sf_dir):
    """Nations stand for records, regions for epochs, of which one is active."""
    epochs = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("epoch"), F.col("r_name").alias("name"), (F.col("r_regionkey") == 3).alias("active"))
    return layout.with_epochs(table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("epoch")), epochs)
