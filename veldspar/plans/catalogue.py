"""Queries of the catalogue, the graphs and the lifecycle over the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldspar.functions import hashing
from veldspar.operators import catalogue, graph, lifecycle
from veldspar.plans.registry import EDGE_SQL, ENTITY_SQL, TIE, _r, _t, edges, entities, query, runs  # noqa: F401

_LI = TIE[1].rsplit(" AS ", 1)[0]

# --- pages -------------------------------------------------------------------------------------------------------

_CHILD = f"SELECT {_LI} AS id, l_orderkey AS run_id, l_shipdate AS created_at, l_linenumber AS n, l_suppkey AS actor FROM lineitem"
_CHILDREN = {"stages": "true", "artifacts": "n % 2 = 0", "metrics": "n % 3 = 0", "reviews": "n % 4 = 1"}


def children(spark, d, name):
    rows = _t(spark, d, "lineitem").selectExpr(f"{_LI} AS id", "l_orderkey AS run_id", "l_shipdate AS created_at", "l_linenumber AS n", "l_suppkey AS actor").where(_CHILDREN[name])
    rows = rows.withColumn("run_stage_id", F.when(F.col("n") % 4 == 0, F.col("id")))
    return rows.withColumnRenamed("created_at", "recorded_at") if name == "reviews" else rows


def _child_page(name, ts):
    """The page after the newest child of the run that has most of them."""

    def run(spark, d):
        rows, parents = children(spark, d, name), runs(spark, d).select("id")
        parent = rows.join(parents.withColumnRenamed("id", "run_id"), "run_id", "left_semi").groupBy("run_id").count().orderBy(F.desc("count"), "run_id").first()["run_id"]
        newest = rows.where(F.col("run_id") == parent).orderBy(F.desc(ts), F.desc("id")).first()
        page = catalogue.child_page(rows, parents, "run_id", parent, ts, "id", 2, (newest[ts], newest["id"]))
        return page.select("id", "run_id", F.col(ts).alias("at"))

    run.__name__ = f"list_{name}_page"
    most = f"(SELECT run_id FROM ({_CHILD}) WHERE {_CHILDREN[name]} AND run_id IN (SELECT o_orderkey FROM orders) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
    sql = f"SELECT id, run_id, created_at AS at FROM ({_CHILD}) WHERE {_CHILDREN[name]} AND run_id = {most} ORDER BY created_at DESC, id DESC LIMIT 3 OFFSET 1"
    return query(sql)(run)


list_artifacts_page = _child_page("artifacts", "created_at")
list_metrics_page = _child_page("metrics", "created_at")
list_reviews_page = _child_page("reviews", "recorded_at")


@query("SELECT event_id AS id, user_id AS run_id, ts AS recorded_at FROM events WHERE user_id = 5 AND (ts < TIMESTAMP '2024-01-20' OR (ts = TIMESTAMP '2024-01-20' AND event_id < 0)) ORDER BY ts DESC, event_id DESC LIMIT 31")
def list_events_page(spark, d):
    ev = _t(spark, d, "events").selectExpr("event_id AS id", "user_id AS run_id", "ts AS recorded_at")
    return catalogue.child_page(ev, ev.select(F.col("run_id").alias("id")), "run_id", 5, "recorded_at", "id", 30, ("2024-01-20", 0))


@query("SELECT c_custkey AS id, c_name AS username, CASE WHEN c_nationkey < 8 THEN 'analyst' WHEN c_nationkey < 16 THEN 'reviewer' ELSE 'admin' END AS role FROM customer WHERE c_acctbal > 0 ORDER BY c_name")
def list_user_accounts(spark, d):
    role = F.when(F.col("c_nationkey") < 8, "analyst").when(F.col("c_nationkey") < 16, "reviewer").otherwise("admin")
    return _t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), role.alias("role")).orderBy("username")


@query("SELECT p_partkey AS id, p_name AS identity, p_type AS payload_type FROM part WHERE p_partkey = 12")
def get_product(spark, d):
    return _t(spark, d, "part").where("p_partkey = 12").selectExpr("p_partkey AS id", "p_name AS identity", "p_type AS payload_type")


@query("""WITH p AS (SELECT p_partkey AS id, p_size AS w, p_partkey % 80 AS s FROM part)
    SELECT id, CASE WHEN id % 5 > 0 THEN 'Polygon' END AS type, CASE WHEN id % 5 > 0 THEN w END AS west, CASE WHEN id % 5 > 0 THEN s + 2 END AS north, 'Point' AS at_type, w + 0.5e0 AS lon FROM p""")
def product_footprints(spark, d):
    p = _t(spark, d, "part").selectExpr("p_partkey AS id", "cast(p_size AS double) AS w", "cast(p_partkey % 80 AS double) AS s")
    corner = lambda dx, dy: F.struct((F.col("w") + dx).alias("lon"), (F.col("s") + dy).alias("lat"))
    ring = F.when(F.col("id") % 5 > 0, F.array(corner(0, 0), corner(3, 0), corner(3, 2), corner(0, 2), corner(0, 0)))
    p = p.select("id", catalogue.polygon_geojson(ring).alias("footprint"), catalogue.point_geojson(F.col("w") + 0.5, F.col("s")).alias("location"))
    back, at = catalogue.polygon_of(F.col("footprint"))["ring"], catalogue.point_of(F.col("location"))
    return p.select("id", F.get_json_object("footprint", "$.type").alias("type"), F.get(back, 0)["lon"].cast("int").alias("west"), F.get(back, 2)["lat"].cast("long").alias("north"), F.get_json_object("location", "$.type").alias("at_type"), at["lon"].alias("lon"))


_SHAPES = """CASE p_partkey % 6 WHEN 0 THEN '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}' WHEN 1 THEN '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,2]]]}' WHEN 2 THEN '{"type":"Polygon","coordinates":[[[0,0],[1,0],[0,0]]]}'
    WHEN 3 THEN '{"type":"Polygon","coordinates":[[[0,0],[1],[1,1],[0,0]]]}' WHEN 4 THEN '{"type":"Point","coordinates":[1,2]}' ELSE 'none' END"""


@query("""SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'ring_not_closed' WHEN 2 THEN 'too_few_positions' WHEN 3 THEN 'bad_position' ELSE 'not_a_polygon' END AS polygon_error,
    CASE p_partkey % 6 WHEN 4 THEN NULL ELSE 'not_a_point' END AS point_error FROM part""")
def geometry_documents_checked(spark, d):
    rows = _t(spark, d, "part").selectExpr("p_partkey AS id", f"{_SHAPES} AS doc")
    return rows.select("id", catalogue.polygon_of(F.col("doc"))["error"].alias("polygon_error"), catalogue.point_of(F.col("doc"))["error"].alias("point_error"))


# --- graphs ------------------------------------------------------------------------------------------------------

_DATED = f"SELECT *, TIMESTAMP '2001-01-01 00:00:00' + INTERVAL 1 HOUR * (length(label) + ascii(right(id, 1))) AS created_at FROM ({ENTITY_SQL})"


def _dated(spark, d):
    hours = F.length("label") + F.ascii(F.right(F.col("id"), F.lit(1)))
    return entities(spark, d).withColumn("created_at", F.timestamp_add("HOUR", hours, F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")))


@query(f"SELECT id, type, label, created_at FROM ({_DATED}) WHERE type = 'PART' AND external_id = 'Brand#11' ORDER BY created_at DESC, id DESC LIMIT 26")
def list_entities_page(spark, d):
    rows = _dated(spark, d).where("type = 'PART' AND external_id = 'Brand#11'")
    return catalogue.keyset_page(rows, "created_at", "id", 25).select("id", "type", "label", "created_at")


@query(f"SELECT id, type, label FROM ({ENTITY_SQL}) WHERE id = 'supplier:3' AND type = 'SUPPLIER'")
def get_entity(spark, d):
    return entities(spark, d).where("id = 'supplier:3' AND type = 'SUPPLIER'").select("id", "type", "label")


@query(f"SELECT id, src, dst, relation FROM ({EDGE_SQL}) WHERE dst = 'supplier:4' AND relation = 'SUPPLIED_BY' ORDER BY created_at DESC, id DESC LIMIT 41")
def list_edges_page(spark, d):
    return catalogue.keyset_page(edges(spark, d).where("dst = 'supplier:4' AND relation = 'SUPPLIED_BY'"), "created_at", "id", 40).select("id", "src", "dst", "relation")


@query(f"""WITH e AS ({EDGE_SQL}), n AS ({ENTITY_SQL}), p AS (SELECT CASE WHEN src = 'nation:4' THEN dst ELSE src END AS other FROM e WHERE (src = 'nation:4' OR dst = 'nation:4') AND relation = 'LOCATED_IN' ORDER BY created_at DESC, id DESC LIMIT 50)
    SELECT id, type, label FROM n WHERE id = 'nation:4' OR (id IN (SELECT other FROM p) AND type = 'SUPPLIER')""")
def observations_of_a_place(spark, d):
    return graph.neighbourhood(edges(spark, d).where("relation = 'LOCATED_IN'"), entities(spark, d), "nation:4", 50, "SUPPLIER")[1]


_QG = f"""WITH e AS ({EDGE_SQL}), n AS ({_DATED}), r AS (SELECT * FROM n WHERE type = 'SUPPLIER' AND (contains(lower(label), '1') OR contains(lower(external_id), '1')) AND EXISTS (SELECT 1 FROM e WHERE relation = 'LOCATED_IN' AND (src = n.id OR dst = n.id)) ORDER BY created_at DESC, id DESC LIMIT 7),
    x AS (SELECT * FROM e WHERE relation = 'SUPPLIED_BY' AND (src IN (SELECT id FROM r) OR dst IN (SELECT id FROM r)) ORDER BY created_at DESC, id DESC LIMIT 61), k AS (SELECT * FROM x ORDER BY created_at DESC, id DESC LIMIT 60)"""


def _query_graph(spark, d):
    return graph.query_graph(_dated(spark, d), edges(spark, d).where("relation = 'SUPPLIED_BY' OR relation = 'LOCATED_IN'"), "1", 60, "SUPPLIER", "LOCATED_IN")


@query(f"""{_QG.replace("'SUPPLIED_BY' AND (src", "'LOCATED_IN' AND (src").replace('LIMIT 7', 'LIMIT 60')} SELECT 'edge' AS part, id, (SELECT count(*) > 60 FROM x) AS flag FROM k UNION ALL SELECT 'root', id, false FROM r UNION ALL SELECT 'node', id, false FROM (SELECT src AS id FROM k UNION SELECT dst FROM k UNION SELECT id FROM r) WHERE id IN (SELECT id FROM n)
    UNION ALL SELECT 'expansion', id, false FROM r WHERE (SELECT count(*) > 60 FROM x)""")
def knowledge_query(spark, d):
    g = _query_graph(spark, d)
    part = lambda name, flag=F.lit(False): g[name].select(F.lit(name[:-1]).alias("part"), "id", flag.alias("flag"))
    return part("edges", F.col("truncated")).unionByName(part("roots")).unionByName(part("nodes")).unionByName(part("expansions"))


_PROV_RUNS = "SELECT o_orderkey AS id, o_orderdate AS created_at, o_custkey AS owner, o_custkey % 150 + 1 AS source_product_id, o_orderkey % 150 + 1 AS reference_product_id FROM orders"


def _prov(spark, d):
    found = {name: children(spark, d, name) for name in _CHILDREN}
    cols = _PROV_RUNS.removeprefix("SELECT ").removesuffix(" FROM orders").split(", ")
    return found | {"runs": _t(spark, d, "orders").selectExpr(*cols), "products": _t(spark, d, "part").selectExpr("p_partkey AS id", "p_size AS owner"), "subjects": _t(spark, d, "customer").selectExpr("c_custkey AS id")}


def _prov_sql(roots: str, extra: str = "") -> str:
    newest = lambda c: f"{c} AS (SELECT * FROM ({_CHILD}) WHERE {_CHILDREN[c]} AND run_id IN (SELECT id FROM r) ORDER BY created_at DESC, id DESC LIMIT 6), {c}_all AS (SELECT count(*) AS n FROM ({_CHILD}) WHERE {_CHILDREN[c]} AND run_id IN (SELECT id FROM r))"
    edge = lambda t, s, rel, o, where="true": f"SELECT {s} || ':{rel}:' || {o} AS id FROM {t} WHERE {where}"
    all_edges = " UNION ".join([
        edge("p", "'product:' || id", "owned_by", "'subject:' || owner"), edge("r", "'run:' || id", "owned_by", "'subject:' || owner"), edge("r", "'run:' || id", "uses_source", "'product:' || source_product_id"),
        edge("r", "'run:' || id", "uses_reference", "'product:' || reference_product_id"), edge("stages", "'stage:' || id", "part_of", "'run:' || run_id"), edge("artifacts", "'artifact:' || id", "artifact_of", "'run:' || run_id"),
        edge("artifacts", "'artifact:' || id", "produced_by", "'stage:' || id", "n % 4 = 0 AND id IN (SELECT id FROM stages)"), edge("metrics", "'metric:' || id", "reported_for", "'run:' || run_id"),
        edge("reviews", "'review:' || id", "reviews", "'run:' || run_id"), edge("reviews", "'review:' || id", "submitted_by", "'subject:' || actor"),
    ])
    return f"""WITH a AS ({_PROV_RUNS}), r AS ({roots}), p AS (SELECT p_partkey AS id, p_size AS owner FROM part WHERE p_partkey IN (SELECT source_product_id FROM r UNION SELECT reference_product_id FROM r{extra})), {", ".join(map(newest, _CHILDREN))},
    s AS (SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT owner FROM p UNION SELECT owner FROM r UNION SELECT actor FROM reviews))
    SELECT 'edge' AS part, id FROM ({all_edges}) UNION ALL SELECT 'node', id FROM (SELECT 'subject:' || id AS id FROM s UNION SELECT 'product:' || id FROM p UNION SELECT 'run:' || id FROM r
    UNION SELECT 'stage:' || id FROM stages UNION SELECT 'artifact:' || id FROM artifacts UNION SELECT 'metric:' || id FROM metrics UNION SELECT 'review:' || id FROM reviews)
    UNION ALL {" UNION ALL ".join(f"SELECT 'truncated', '{c}' FROM {c}_all WHERE n > 6" for c in _CHILDREN)}"""


def _flat(g):
    out = g["edges"].select(F.lit("edge").alias("part"), "id").unionByName(g["nodes"].select(F.lit("node").alias("part"), "id"))
    return out.unionByName(g["truncated"].select(F.lit("truncated").alias("part"), F.col("collection").alias("id")))


@query(_prov_sql("SELECT * FROM a WHERE id = 3"))
def provenance_of_a_run(spark, d):
    return _flat(graph.provenance(_prov(spark, d), 6, run_id=3))


@query(_prov_sql("SELECT * FROM a WHERE source_product_id = 9 OR reference_product_id = 9 ORDER BY created_at DESC, id DESC LIMIT 6", " UNION SELECT 9"))
def provenance_of_a_product(spark, d):
    return _flat(graph.provenance(_prov(spark, d), 6, product_id=9))


@query(_prov_sql("SELECT * FROM a ORDER BY created_at DESC, id DESC LIMIT 6"))
def provenance_of_newest_runs(spark, d):
    return _flat(graph.provenance(_prov(spark, d), 6))


# --- lifecycle ---------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT user_id AS key, event_type AS digest, ts AS tm, event_id AS ord FROM events), w AS (SELECT *, first_value(digest) OVER p AS f, first_value(tm) OVER p AS t0, row_number() OVER p AS n FROM c WINDOW p AS (PARTITION BY key ORDER BY tm, ord))
    SELECT key, digest, ord, CASE WHEN n = 1 THEN 'created' WHEN tm > t0 + INTERVAL 24 HOUR THEN 'expired' WHEN digest = f THEN 'replayed' ELSE 'conflict' END AS outcome FROM w""")
def idempotent_replay_with_expiry(spark, d):
    return lifecycle.replay_within(_t(spark, d, "events").selectExpr("user_id AS key", "event_type AS digest", "ts AS at", "event_id AS ord")).select("key", "digest", "ord", "outcome")


_WANTED = "CASE event_id % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'cancelling' WHEN 3 THEN 'succeeded' ELSE 'cancelled' END"
_EXPECTED = "CASE event_id % 3 WHEN 0 THEN 'created' WHEN 1 THEN 'queued' ELSE 'running' END"


@query(f"""WITH RECURSIVE q AS (SELECT user_id AS run_id, event_id AS ord, {_EXPECTED} AS es, event_id % 3 + 1 AS ev, {_WANTED} AS ns, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    s(run_id, n, ord, accepted, state, version) AS (SELECT DISTINCT run_id, 0::BIGINT, 0::BIGINT, false, 'created', 1::BIGINT FROM q UNION ALL
        SELECT q.run_id, q.n, q.ord, k.ok, CASE WHEN k.ok THEN ns ELSE state END, version + k.ok::INT FROM s JOIN q ON q.run_id = s.run_id AND q.n = s.n + 1, LATERAL (SELECT es = state AND ev = version AND (state, ns) IN (('created','queued'),('created','cancelled'),('queued','running'),('queued','cancelled'),('running','cancelling'),('running','succeeded'),('running','failed'),('cancelling','cancelled'),('cancelling','failed')) AS ok) k)
    SELECT run_id, ord, accepted, state, version AS state_version, version AS event_sequence FROM s WHERE n > 0""")
def state_transitions_applied(spark, d):
    return lifecycle.apply_transitions(_t(spark, d, "events").selectExpr("user_id AS run_id", "event_id AS ord", f"{_EXPECTED} AS expected_state", "event_id % 3 + 1 AS expected_version", f"{_WANTED} AS new_state"))


@query("""WITH r AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'running' ELSE 'failed' END AS state, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'accept' WHEN 2 THEN 'reject' ELSE 'review' END AS verdict FROM orders WHERE o_orderkey % 9 <> 5),
    v AS (SELECT l_orderkey AS run_id, l_linenumber AS ord, l_partkey, CASE l_suppkey % 4 WHEN 0 THEN 'analyst' WHEN 1 THEN 'reviewer' WHEN 2 THEN 'admin' END AS role, CASE l_returnflag WHEN 'R' THEN 'rejected' WHEN 'A' THEN 'accepted' ELSE 'maybe' END AS decision FROM lineitem),
    x AS (SELECT v.*, verdict, CASE WHEN role = 'analyst' THEN 'role_not_allowed' WHEN r.id IS NULL THEN 'run_not_found' WHEN state <> 'succeeded' OR verdict IS NULL THEN 'run_not_reviewable' WHEN decision = 'maybe' THEN 'decision_unknown' END AS refusal FROM v LEFT JOIN r ON r.id = run_id)
    SELECT run_id, ord, l_partkey, refusal, CASE WHEN refusal IS NULL THEN CASE verdict WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected' ELSE decision END END AS disposition FROM x""")
def reviews_submitted(spark, d):
    r = _t(spark, d, "orders").where("o_orderkey % 9 <> 5").selectExpr("o_orderkey AS id", "CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'running' ELSE 'failed' END AS state", "CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'accept' WHEN 2 THEN 'reject' ELSE 'review' END AS verdict")
    v = _t(spark, d, "lineitem").selectExpr("l_orderkey AS run_id", "l_linenumber AS ord", "l_partkey", "CASE l_suppkey % 4 WHEN 0 THEN 'analyst' WHEN 1 THEN 'reviewer' WHEN 2 THEN 'admin' END AS actor_role", "CASE l_returnflag WHEN 'R' THEN 'rejected' WHEN 'A' THEN 'accepted' ELSE 'maybe' END AS decision")
    return lifecycle.review_outcomes(v, r).select("run_id", "ord", "l_partkey", "refusal", "disposition")


@query("SELECT o_orderkey AS run_id, 1::BIGINT AS sequence, 'run.created' AS event_type, 'created' AS state, o_orderdate AS recorded_at FROM orders")
def new_run_events(spark, d):
    return lifecycle.new_run_events(runs(spark, d))


@query("SELECT c_nationkey AS owner, c_mktsegment AS identity, min(c_custkey) AS id FROM customer WHERE (c_nationkey, c_mktsegment) NOT IN (SELECT s_nationkey, 'BUILDING' FROM supplier) GROUP BY 1, 2")
def products_created_once(spark, d):
    new = _t(spark, d, "customer").selectExpr("c_nationkey AS owner", "c_mktsegment AS identity", "c_custkey AS id")
    stored = _t(spark, d, "supplier").selectExpr("s_nationkey AS owner", "'BUILDING' AS identity")
    return lifecycle.insert_if_absent(new, stored, ["owner", "identity"], ["id"])


@query(f"""WITH e AS ({EDGE_SQL}), n AS (SELECT id FROM ({ENTITY_SQL}) WHERE right(id, 1) <> '7') SELECT id, concat_ws(',', CASE WHEN src NOT IN (SELECT id FROM n) THEN 'src' END, CASE WHEN dst NOT IN (SELECT id FROM n) THEN 'dst' END) AS missing FROM e""")
def edges_with_missing_ends(spark, d):
    known = entities(spark, d).where("right(id, 1) <> '7'").select("id")
    return lifecycle.missing_parents(edges(spark, d).select("id", "src", "dst"), {"src": known, "dst": known}).select("id", "missing")


_DOC = """'{"run" : ' || o_orderkey || ', "b":null, "a": [ ' || o_custkey || ', {"y":true,"x":"é"} ] , "local-Path": "/x"}'"""


@query("""SELECT o_orderkey AS id, sha256('{"a":[' || o_custkey || ',{"x":"é","y":true}],"b":null,"local-Path":"/x","run":' || o_orderkey || '}') AS digest,
    sha256('{"a":[' || o_custkey || ',{"x":"\\u00e9","y":true}],"local-Path":"/x","run":' || o_orderkey || '}') AS request_digest, 'local_path' AS server_paths FROM orders""".replace("\\\\", "\\"))
def canonical_digests(spark, d):
    rows = _t(spark, d, "orders").selectExpr("o_orderkey AS id", f"{_DOC} AS doc")
    return rows.select("id", hashing.digest_json(F.col("doc")).alias("digest"), hashing.digest_json(F.col("doc"), ascii_only=True, drop_nulls=True).alias("request_digest"), F.array_join(hashing.server_paths(F.col("doc")), ",").alias("server_paths"))


# --- runs as documents -------------------------------------------------------------------------------------------

@query(f"""WITH k AS ({_CHILD}), s AS (SELECT run_id, {', '.join(f"count(*) FILTER ({where})::BIGINT AS {name}" for name, where in _CHILDREN.items())}, max(created_at) FILTER (n % 2 = 0) AS newest_artifact FROM k GROUP BY 1), e AS (SELECT user_id, count(*)::BIGINT AS events, min(ts) AS first_event FROM events GROUP BY 1)
    SELECT o_orderkey AS id, {', '.join(f"coalesce({name}, 0) AS {name}" for name in _CHILDREN)}, coalesce(events, 0) AS events, newest_artifact, first_event, o_orderkey % 3 > 0 AS parameter_manifest_available FROM orders LEFT JOIN s ON s.run_id = o_orderkey LEFT JOIN e ON user_id = o_orderkey""")
def run_details(spark, d):
    """A run with all five of its child collections, in order, and whether its parameters are on record."""
    ev = _t(spark, d, "events").selectExpr("user_id AS id", "ts AS at", "event_id AS event")
    kids = {name: (children(spark, d, name).withColumnRenamed("id", "child").withColumnRenamed("run_id", "id").withColumnRenamed("recorded_at" if name == "reviews" else "created_at", "at"), ["at", "child"]) for name in _CHILDREN}
    rows = runs(spark, d).select("id", F.when(F.col("id") % 3 > 0, F.lit("{}")).alias("parameter_manifest"))
    rows = catalogue.run_documents(catalogue.nested_children(rows, "id", {**kids, "events": (ev, ["at", "event"])}))
    return rows.select("id", *(F.coalesce(F.size(c), F.lit(0)).cast("long").alias(c) for c in (*_CHILDREN, "events")), F.array_max(F.transform("artifacts", lambda x: x["at"])).alias("newest_artifact"), F.get("events", F.lit(0))["at"].alias("first_event"), "parameter_manifest_available")
