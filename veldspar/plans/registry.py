"""Queries of the engine over the test tables, each with its SQL.

The model's tables are derived from the test tables by expressions that Spark and the checking SQL engine read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldspar.functions import geometry as geo
from veldspar.functions import hashing
from veldspar.operators import catalogue, coverage, gates, governance, graph, lifecycle, matching, pyramid, raster, tiepoints

# --- derived tables ----------------------------------------------------------------------------------------------

TIE = [
    "l_partkey AS job_id",
    "concat_ws('-', cast(l_orderkey AS string), cast(l_linenumber AS string), cast(l_partkey AS string), cast(l_suppkey AS string), cast(cast(round(l_extendedprice * 100) AS bigint) AS string)) AS match_id",
    "cast((l_orderkey * 37 + l_linenumber * 11) % 1024 AS double) AS line",
    "cast((l_partkey * 53 + l_orderkey * 7) % 1024 AS double) AS sample",
    "cast((l_orderkey * 37 + l_linenumber * 11) % 1024 + l_suppkey % 5 - 2 AS double) AS ref_line",
    "cast((l_partkey * 53 + l_orderkey * 7) % 1024 + l_linenumber % 3 - 1 AS double) AS ref_sample",
    "l_quantity AS score",
    "l_discount > 0.025 AS is_inlier",
    "l_tax * 10 AS residual_px",
]
RUNS = ["o_orderkey AS id", "o_orderdate AS created_at", "CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'running' ELSE 'failed' END AS state", "o_custkey AS owner", "o_orderpriority AS environment"]
PIXEL_SQL = "SELECT cast(label AS bigint) AS image_id, cast(vec_id AS bigint) AS line, cast(p - 1 AS bigint) AS sample, cast(embedding[p] AS double) AS value, embedding[p] > -0.15 AS valid FROM (SELECT label, vec_id, embedding, unnest(range(1, 65)) AS p FROM embeddings)"
ENTITY_SQL = """SELECT 'part:' || p_partkey AS id, 'PART' AS type, p_name AS label, p_brand AS external_id FROM part
    UNION ALL SELECT 'supplier:' || s_suppkey, 'SUPPLIER', s_name, 'nation ' || s_nationkey FROM supplier
    UNION ALL SELECT 'nation:' || n_nationkey, 'NATION', n_name, 'region ' || n_regionkey FROM nation"""
EDGE_SQL = """SELECT concat_ws('-', l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR, l_suppkey::VARCHAR, cast(round(l_extendedprice * 100) AS bigint)::VARCHAR) AS id,
    'part:' || l_partkey AS src, 'supplier:' || l_suppkey AS dst, 'SUPPLIED_BY' AS relation, l_shipdate AS created_at FROM lineitem
    UNION ALL SELECT 'sn-' || s_suppkey, 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'LOCATED_IN', TIMESTAMP '2000-01-01 00:00:00' FROM supplier"""
TIE_SQL = f"SELECT {', '.join(TIE)} FROM lineitem"
RUN_SQL = f"SELECT {', '.join(RUNS)} FROM orders"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def ties(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").selectExpr(*TIE)


def runs(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").selectExpr(*RUNS)


def pixels(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "embeddings").select(F.col("label").cast("long").alias("image_id"), F.col("vec_id").alias("line"), F.posexplode("embedding").alias("sample", "v"))
    return rows.select("image_id", "line", F.col("sample").cast("long"), F.col("v").cast("double").alias("value"), (F.col("v") > -0.15).alias("valid"))


def entities(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part").selectExpr("'part:' || p_partkey AS id", "'PART' AS type", "p_name AS label", "p_brand AS external_id")
    s = _t(spark, d, "supplier").selectExpr("'supplier:' || s_suppkey AS id", "'SUPPLIER' AS type", "s_name AS label", "'nation ' || s_nationkey AS external_id")
    n = _t(spark, d, "nation").selectExpr("'nation:' || n_nationkey AS id", "'NATION' AS type", "n_name AS label", "'region ' || n_regionkey AS external_id")
    return p.unionByName(s).unionByName(n)


def edges(spark: SparkSession, d: str) -> DataFrame:
    li = _t(spark, d, "lineitem").selectExpr(TIE[1].replace("AS match_id", "AS id"), "'part:' || l_partkey AS src", "'supplier:' || l_suppkey AS dst", "'SUPPLIED_BY' AS relation", "l_shipdate AS created_at")
    su = _t(spark, d, "supplier").selectExpr("'sn-' || s_suppkey AS id", "'supplier:' || s_suppkey AS src", "'nation:' || s_nationkey AS dst", "'LOCATED_IN' AS relation", "TIMESTAMP_NTZ '2000-01-01 00:00:00' AS created_at")
    return li.withColumn("created_at", F.col("created_at").cast("timestamp_ntz")).unionByName(su)


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _r(c, n: int = 6):
    """c to n decimals by scaling, as the SQL side rounds doubles; F.round would go by the shortest decimal form, and differ at ties."""
    return F.round(c * 10.0**n) / 10.0**n


# --- catalogue ---------------------------------------------------------------------------------------------------


@query(f"SELECT id, created_at, state, owner, environment FROM ({RUN_SQL}) WHERE state = 'succeeded' AND (created_at < TIMESTAMP '1999-06-01' OR (created_at = TIMESTAMP '1999-06-01' AND id < 100000)) ORDER BY created_at DESC, id DESC LIMIT 51")
def list_runs_page(spark, d):
    return catalogue.keyset_page(runs(spark, d).where("state = 'succeeded'"), "created_at", "id", 50, ("1999-06-01", 100000))


@query(f"SELECT id, state, environment FROM ({RUN_SQL}) WHERE contains(lower(environment), '1-urg') OR contains(lower(cast(owner AS varchar)), '77') OR contains(lower(state), '%')")
def search_runs(spark, d):
    return runs(spark, d).where(catalogue.literal_search("1-URG", ["environment"]) | catalogue.literal_search("77", ["owner"]) | catalogue.literal_search("%", ["state"])).select("id", "state", "environment")


@query("SELECT p_partkey AS id, p_name AS identity, p_type AS payload_type FROM part WHERE p_size > 25 AND (contains(lower(p_name), 'blue') OR contains(lower(p_type), 'steel') OR contains(lower(p_brand), '#1')) ORDER BY p_partkey DESC LIMIT 101")
def list_products_page(spark, d):
    rows = _t(spark, d, "part").where("p_size > 25").where(catalogue.literal_search("blue", ["p_name"]) | catalogue.literal_search("STEEL", ["p_type"]) | catalogue.literal_search("#1", ["p_brand"]))
    return rows.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("identity"), F.col("p_type").alias("payload_type")).orderBy(F.desc("id")).limit(101)


@query("SELECT o_orderkey AS id, o_custkey AS owner FROM orders WHERE o_orderkey = 7")
def get_run(spark, d):
    return runs(spark, d).where("id = 7").select("id", "owner")


@query("SELECT l_orderkey AS run_id, l_linenumber AS ordinal, l_shipdate AS created_at, l_partkey AS part FROM lineitem WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem) ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC LIMIT 21")
def list_stages_page(spark, d):
    li = _t(spark, d, "lineitem")
    first = li.agg(F.min("l_orderkey").alias("k"))
    rows = li.join(F.broadcast(first), li["l_orderkey"] == first["k"], "left_semi")
    return rows.orderBy(F.desc("l_shipdate"), F.desc("l_linenumber"), F.desc("l_partkey")).limit(21).selectExpr("l_orderkey AS run_id", "l_linenumber AS ordinal", "l_shipdate AS created_at", "l_partkey AS part")


@query("""WITH k AS (SELECT c_custkey AS owner FROM customer WHERE c_mktsegment = 'BUILDING'), r AS (SELECT o_orderkey AS id, o_orderdate AS created_at, o_custkey AS owner FROM orders WHERE o_custkey IN (SELECT owner FROM k))
    SELECT *, (SELECT count(*) FROM r) > 40 AS truncated FROM r ORDER BY created_at DESC, id DESC LIMIT 40""")
def records_for_owners(spark, d):
    keys = _t(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("owner"))
    return catalogue.records_for(runs(spark, d).select("id", "created_at", "owner"), "owner", keys, "created_at", "id", 40)


@query("""WITH e AS (SELECT user_id AS run_id, ts AS recorded_at, event_id AS id, event_type AS detail, 'event' AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type <> 'purchase'),
    r AS (SELECT user_id AS run_id, ts AS recorded_at, event_id AS id, event_type AS detail, 'review' AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'purchase')
    SELECT run_id, recorded_at, id, detail, kind FROM e WHERE n <= 5 UNION ALL SELECT run_id, recorded_at, id, detail, kind FROM r WHERE n <= 5""")
def audit_activity(spark, d):
    ev = _t(spark, d, "events").selectExpr("user_id AS run_id", "ts AS recorded_at", "event_id AS id", "event_type AS detail")
    return catalogue.activity({"event": ev.where("detail <> 'purchase'"), "review": ev.where("detail = 'purchase'")}, 5)


@query("""SELECT o_orderkey AS id, count(l_orderkey)::BIGINT AS stages, coalesce(sum(l_linenumber), 0)::BIGINT AS ordinals FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def run_detail_nested(spark, d):
    stages = _t(spark, d, "lineitem").selectExpr("l_orderkey AS id", "l_linenumber AS ordinal", "l_shipdate AS at", "l_partkey AS part")
    rows = catalogue.nested_children(runs(spark, d).select("id"), "id", {"stages": (stages, ["ordinal", "at", "part"])})
    return rows.select("id", F.coalesce(F.size("stages"), F.lit(0)).cast("long").alias("stages"), F.coalesce(F.aggregate("stages", F.lit(0).cast("long"), lambda a, s: a + s["ordinal"]), F.lit(0)).alias("ordinals"))


# --- graph -------------------------------------------------------------------------------------------------------


@query(f"""WITH e AS ({EDGE_SQL}), n AS ({ENTITY_SQL}), p AS (SELECT *, CASE WHEN src = 'supplier:3' THEN dst ELSE src END AS other FROM e WHERE src = 'supplier:3' OR dst = 'supplier:3' ORDER BY created_at DESC, id DESC LIMIT 60)
    SELECT p.id, p.relation, p.other, n.type, n.label FROM p JOIN n ON n.id = p.other WHERE n.type = 'PART'""")
def knowledge_neighbours(spark, d):
    return graph.neighbours(edges(spark, d), entities(spark, d), "supplier:3", 60, "PART").select("id", "relation", "other", "type", "label")


_ROOTS = f"WITH e AS ({EDGE_SQL}), n AS ({ENTITY_SQL}), r AS (SELECT * FROM n WHERE type = 'SUPPLIER' AND (contains(lower(label), '1') OR contains(lower(external_id), '1')) AND EXISTS (SELECT 1 FROM e WHERE relation = 'LOCATED_IN' AND (src = n.id OR dst = n.id)))"


@query(f"{_ROOTS} SELECT id, type, label FROM r")
def knowledge_query_roots(spark, d):
    return graph.lexical_roots(entities(spark, d), edges(spark, d), "1", "SUPPLIER", "LOCATED_IN").select("id", "type", "label")


@query(f"{_ROOTS} SELECT id, src, dst, relation FROM e WHERE relation = 'SUPPLIED_BY' AND (src IN (SELECT id FROM r) OR dst IN (SELECT id FROM r)) ORDER BY created_at DESC, id DESC LIMIT 300")
def knowledge_expand(spark, d):
    roots = graph.lexical_roots(entities(spark, d), edges(spark, d), "1", "SUPPLIER", "LOCATED_IN")
    return graph.expand(roots, edges(spark, d), 300, "SUPPLIED_BY").select("id", "src", "dst", "relation")


@query(f"""WITH e AS ({EDGE_SQL}), n AS ({ENTITY_SQL}), s AS (SELECT id FROM n WHERE type <> 'PART' OR contains(lower(label), 'a'))
    SELECT count(*)::BIGINT AS edges, count(DISTINCT src)::BIGINT AS sources FROM e WHERE src IN (SELECT id FROM s) AND dst IN (SELECT id FROM s)""")
def loaded_subgraph(spark, d):
    nodes = entities(spark, d).where((F.col("type") != "PART") | F.contains(F.lower("label"), F.lit("a")))
    return graph.loaded_edges(edges(spark, d), nodes).agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("src").alias("sources"))


@query("""WITH x AS (SELECT 'run:' || o_orderkey AS source, 'owned_by' AS relation, 'subject:' || o_custkey AS target FROM orders
    UNION SELECT 'run:' || l_orderkey, 'uses_source', 'product:' || l_partkey FROM lineitem UNION SELECT 'stage:' || l_orderkey || '/' || l_linenumber, 'part_of', 'run:' || l_orderkey FROM lineitem)
    SELECT source || ':' || relation || ':' || target AS id, source, relation, target FROM x""")
def provenance_graph(spark, d):
    o, li = _t(spark, d, "orders"), _t(spark, d, "lineitem")
    return graph.projection([
        graph.edge(o, "'run:' || o_orderkey", "owned_by", "'subject:' || o_custkey"),
        graph.edge(li, "'run:' || l_orderkey", "uses_source", "'product:' || l_partkey"),
        graph.edge(li, "'stage:' || l_orderkey || '/' || l_linenumber", "part_of", "'run:' || l_orderkey"),
    ])


# --- lifecycle ---------------------------------------------------------------------------------------------------

_STATE = "CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'queued' WHEN 'purchase' THEN 'succeeded' WHEN 'scroll' THEN 'failed' ELSE 'created' END"
_EVENTS = f"SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, {_STATE} AS state FROM events"


def _events(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _t(spark, d, "events").select(F.col("user_id").alias("run_id"), F.row_number().over(w).cast("long").alias("sequence"), F.expr(_STATE).alias("state"))


@query(f"""WITH e AS ({_EVENTS}), p AS (SELECT *, lag(state) OVER (PARTITION BY run_id ORDER BY sequence) AS previous FROM e)
    SELECT run_id, sequence, previous, state FROM p WHERE previous IS NOT NULL AND (previous, state) NOT IN (VALUES ('created','queued'),('created','cancelled'),('queued','running'),('queued','cancelled'),('running','cancelling'),('running','succeeded'),('running','failed'),('cancelling','cancelled'),('cancelling','failed'))""")
def transition_violations(spark, d):
    return lifecycle.transition_violations(_events(spark, d))


@query(f"WITH e AS ({_EVENTS}) SELECT run_id, arg_max(state, sequence) AS state, max(sequence) AS event_sequence, count(*) AS events FROM e GROUP BY run_id")
def run_state_fold(spark, d):
    return lifecycle.latest_state(_events(spark, d))


@query(f"WITH e AS ({_EVENTS}), s AS (SELECT run_id, arg_max(state, sequence) AS state FROM e GROUP BY run_id) SELECT run_id, CASE WHEN state IN ('created', 'queued') THEN 'cancelled' WHEN state = 'running' THEN 'cancelling' END AS target FROM s")
def cancellation_targets(spark, d):
    return lifecycle.latest_state(_events(spark, d)).select("run_id", lifecycle.cancellation_target(F.col("state")).alias("target"))


@query("""WITH s AS (SELECT o_orderkey AS scene, CASE o_orderstatus WHEN 'F' THEN 'review' WHEN 'O' THEN 'accept' ELSE 'reject' END AS verdict FROM orders),
    r AS (SELECT l_orderkey AS scene, arg_max(CASE WHEN l_returnflag = 'R' THEN 'rejected' ELSE 'accepted' END, (l_shipdate, l_linenumber, l_partkey, l_suppkey)) AS decision FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
    SELECT scene, verdict, CASE verdict WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected' ELSE coalesce(decision, 'pending') END AS disposition FROM s LEFT JOIN r USING (scene)""")
def effective_dispositions(spark, d):
    scenes = _t(spark, d, "orders").selectExpr("o_orderkey AS scene", "CASE o_orderstatus WHEN 'F' THEN 'review' WHEN 'O' THEN 'accept' ELSE 'reject' END AS verdict")
    reviews = _t(spark, d, "lineitem").selectExpr("l_orderkey AS scene", "CASE WHEN l_linestatus = 'F' THEN 'review' ELSE 'accept' END AS input_verdict", "CASE WHEN l_returnflag = 'R' THEN 'rejected' ELSE 'accepted' END AS decision", "l_shipdate AS at", "struct(l_linenumber, l_partkey, l_suppkey) AS ord")
    return lifecycle.effective_disposition(scenes, reviews).select("scene", "verdict", "disposition")


@query("""WITH c AS (SELECT user_id AS key, event_type AS digest, ts AS tm, event_id AS ord FROM events), w AS (SELECT *, first_value(digest) OVER p AS f, row_number() OVER p AS n FROM c WINDOW p AS (PARTITION BY key ORDER BY tm, ord))
    SELECT key, digest, ord, CASE WHEN n = 1 THEN 'created' WHEN digest = f THEN 'replayed' ELSE 'conflict' END AS outcome FROM w""")
def idempotent_replay(spark, d):
    return lifecycle.replay(_t(spark, d, "events").selectExpr("user_id AS key", "event_type AS digest", "ts AS at", "event_id AS ord")).select("key", "digest", "ord", "outcome")


# --- tie points --------------------------------------------------------------------------------------------------


@query(f"WITH t AS ({TIE_SQL}) SELECT a.job_id, a.match_id AS a_match_id, b.match_id AS b_match_id FROM t a JOIN t b ON a.job_id = b.job_id AND a.match_id <> b.match_id AND sqrt((a.line - b.line) ** 2 + (a.sample - b.sample) ** 2) <= 40")
def tie_point_neighbours(spark, d):
    return tiepoints.within(ties(spark, d), 40.0).select("job_id", "a_match_id", "b_match_id")


@query(f"""WITH RECURSIVE t AS ({TIE_SQL}), p AS (SELECT a.job_id, a.match_id AS a, b.match_id AS b FROM t a JOIN t b ON a.job_id = b.job_id AND a.match_id <> b.match_id AND sqrt((a.line - b.line) ** 2 + (a.sample - b.sample) ** 2) <= 40),
    c(job_id, m, l) AS (SELECT job_id, match_id, match_id FROM t UNION SELECT c.job_id, p.b, c.l FROM c JOIN p ON p.job_id = c.job_id AND p.a = c.m),
    k AS (SELECT job_id, m, min(l) AS l FROM c GROUP BY 1, 2), w AS (SELECT t.job_id, match_id, row_number() OVER (PARTITION BY t.job_id, l ORDER BY score DESC, match_id) AS n FROM t JOIN k ON k.job_id = t.job_id AND k.m = t.match_id)
    SELECT job_id, match_id FROM w WHERE n = 1""")
def duplicate_candidates_removed(spark, d):
    return tiepoints.remove_duplicates(ties(spark, d), 40.0).select("job_id", "match_id")


_GREEDY = """WITH RECURSIVE t AS ({rows}), o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY {order}) AS n FROM t WHERE live),
    s(job_id, n, won) AS (SELECT DISTINCT job_id, 0::BIGINT, []::STRUCT(m VARCHAR, t VARCHAR, l DOUBLE, s DOUBLE, rl DOUBLE, rs DOUBLE)[] FROM o
        UNION ALL SELECT s.job_id, o.n, CASE WHEN len(list_filter(won, lambda w: {near})) = 0 THEN list_append(won, {{'m': match_id, 't': tile_id, 'l': line, 's': sample, 'rl': ref_line, 'rs': ref_sample}}) ELSE won END FROM s JOIN o ON o.job_id = s.job_id AND o.n = s.n + 1),
    f AS (SELECT job_id, arg_max(won, n) AS won FROM s GROUP BY 1)"""


@query(_GREEDY.format(rows=f"SELECT *, true AS live, '' AS tile_id FROM ({TIE_SQL})", order="score DESC, match_id", near="sqrt((w.l - line) ** 2 + (w.s - sample) ** 2) <= 40") + """
    SELECT t.job_id, match_id, CASE WHEN list_contains(list_transform(won, lambda w: w.m), match_id) THEN 'survived' ELSE 'suppressed' END AS nms_status FROM t JOIN f ON f.job_id = t.job_id""")
def non_maximum_suppression(spark, d):
    return tiepoints.suppress_non_maxima(ties(spark, d), 40.0).select("job_id", "match_id", "nms_status")


_REV = "SELECT job_id, 'r' || match_id AS rev_id, ref_line + 1 AS ref_line, ref_sample AS ref_sample, line + 2 AS line, sample - 1 AS sample FROM t WHERE score > 10"
_FB = f"""WITH t AS ({TIE_SQL}), r AS ({_REV}), m AS (SELECT t.job_id, t.match_id, sqrt((t.ref_line - r.ref_line) ** 2 + (t.ref_sample - r.ref_sample) ** 2) AS anchor, sqrt((t.line - r.line) ** 2 + (t.sample - r.sample) ** 2) AS trip, rev_id FROM t JOIN r ON t.job_id = r.job_id),
    b AS (SELECT job_id, match_id, min((anchor, trip, rev_id)) AS m FROM m WHERE anchor <= 3 GROUP BY 1, 2), x AS (SELECT t.job_id, t.match_id, b.m[2] AS trip FROM t LEFT JOIN b USING (job_id, match_id))"""


def _fb(spark, d, mode):
    t = ties(spark, d)
    rev = t.where("score > 10").selectExpr("job_id", "'r' || match_id AS rev_id", "ref_line + 1 AS ref_line", "ref_sample", "line + 2 AS line", "sample - 1 AS sample")
    return tiepoints.verify_forward_backward(t, rev, 3.0, 2.5, mode)


@query(f"{_FB} SELECT job_id, match_id, round(CASE WHEN trip <= 2.5 THEN trip END, 6) AS forward_backward_error_px FROM x".replace("b.m[2]", "struct_extract(b.m, 2)"))
def forward_backward_annotated(spark, d):
    return _fb(spark, d, "annotate").select("job_id", "match_id", _r(F.col("forward_backward_error_px")).alias("forward_backward_error_px"))


@query(f"{_FB} SELECT job_id, match_id, CASE WHEN trip IS NULL THEN 'no_reverse_match' WHEN trip > 2.5 THEN 'round_trip_exceeded' END AS rejection_reason FROM x".replace("b.m[2]", "struct_extract(b.m, 2)"))
def forward_backward_rejected(spark, d):
    return _fb(spark, d, "reject").select("job_id", "match_id", "rejection_reason")


_AFFINE = """a AS (SELECT {key}, count(*) AS n, avg(line) AS mx, avg(sample) AS my, var_pop(line) AS vx, var_pop(sample) AS vy, covar_pop(line, sample) AS vxy, avg(ref_line) AS mu, avg(ref_sample) AS mv,
    covar_pop(line, ref_line) AS xu, covar_pop(sample, ref_line) AS yu, covar_pop(line, ref_sample) AS xv, covar_pop(sample, ref_sample) AS yv FROM {rows} GROUP BY ALL),
    e AS (SELECT *, CASE WHEN n >= 3 AND vx * vy - vxy * vxy > 1e-12 * vx * vy THEN vx * vy - vxy * vxy END AS det FROM a),
    g AS (SELECT *, (xu * vy - yu * vxy) / det AS u_line, (yu * vx - xu * vxy) / det AS u_sample, (xv * vy - yv * vxy) / det AS v_line, (yv * vx - xv * vxy) / det AS v_sample FROM e),
    fit AS (SELECT *, mu - u_line * mx - u_sample * my AS u_shift, mv - v_line * mx - v_sample * my AS v_shift FROM g)"""


@query(f"WITH t AS ({TIE_SQL}), {_AFFINE.format(key='job_id', rows='t')} SELECT job_id, n, " + ", ".join(f"round({t}_{k}, 4) AS {t}_{k}" for t in "uv" for k in ("line", "sample", "shift")) + " FROM fit")
def affine_fit(spark, d):
    rows = tiepoints.affine_normal_fit(ties(spark, d), ["job_id"])
    return rows.select("job_id", "n", *[_r(F.col(f"{t}_{k}"), 4).alias(f"{t}_{k}") for t in "uv" for k in ("line", "sample", "shift")])


@query()
def robust_affine_fit(spark, d):
    return tiepoints.robust_affine(ties(spark, d), 3.0).select("job_id", "match_id", _r(F.col("residual_px"), 4).alias("residual_px"), "is_inlier", "rejection_reason")


_CELL = "least(greatest(floor(line / 1024.0e0 * 8), 0), 7)::INT"
_CELLS = f"WITH t AS ({TIE_SQL}), g AS (SELECT *, {_CELL} AS \"row\", {_CELL.replace('line', 'sample')} AS col FROM t), q AS (SELECT *, is_inlier AND (\"row\" * 3 + col * 5) % 7 <> 0 AS part FROM g), w AS (SELECT *, row_number() OVER (PARTITION BY job_id, \"row\", col, part ORDER BY score DESC, match_id) AS n FROM q), s AS (SELECT *, part AND n = 1 AND score >= 12 AS selected FROM w)"


def _selected(spark, d):
    grid = spark.range(64).selectExpr("cast(id div 8 AS int) AS row", "cast(id % 8 AS int) AS col", "((id div 8) * 3 + (id % 8) * 5) % 7 <> 0 AS eligible")
    return tiepoints.select_grid_coverage(tiepoints.with_cells(ties(spark, d), 1024, 1024), grid, 12.0)


@query(f"{_CELLS} SELECT job_id, match_id, \"row\", col, selected, CASE WHEN NOT part THEN NULL WHEN selected THEN 'selected' WHEN n = 1 THEN 'below_floor' ELSE 'outranked' END AS rationale FROM s")
def grid_coverage_selection(spark, d):
    return _selected(spark, d).select("job_id", "match_id", "row", "col", "selected", "rationale")


@query(f"""{_CELLS}, c AS (SELECT job_id, "row", col, count(*) AS n FROM s WHERE selected GROUP BY 1, 2, 3), e AS (SELECT job_id, "row", col FROM c UNION ALL SELECT job_id, r, x FROM (SELECT DISTINCT job_id FROM t), range(8) AS rr(r), (VALUES (-1), (8)) AS v(x)),
    gp AS (SELECT job_id, col - lag(col) OVER (PARTITION BY job_id, "row" ORDER BY col) - 1 AS gap FROM e), rn AS (SELECT job_id, max(gap)::BIGINT AS longest_empty_run FROM gp GROUP BY 1), st AS (SELECT job_id, count(*)::BIGINT AS occupied, max(n)::BIGINT AS most FROM c GROUP BY 1)
    SELECT job_id, longest_empty_run, coalesce(occupied, 0) AS occupied, coalesce(most, 0) AS most, coalesce(occupied, 0) / 64.0e0 AS occupancy FROM rn LEFT JOIN st USING (job_id)""")
def coverage_uniformity(spark, d):
    return tiepoints.uniformity_grid(_selected(spark, d))


_HULL = """p AS (SELECT DISTINCT job_id, line, sample FROM {rows}), h AS (SELECT a.job_id, a.line * b.sample - b.line * a.sample AS part FROM p a JOIN p b ON b.job_id = a.job_id AND (a.line, a.sample) <> (b.line, b.sample)
    JOIN p c ON c.job_id = a.job_id GROUP BY a.job_id, a.line, a.sample, b.line, b.sample HAVING bool_and((b.line - a.line) * (c.sample - a.sample) - (b.sample - a.sample) * (c.line - a.line) > 0
        OR ((b.line - a.line) * (c.sample - a.sample) = (b.sample - a.sample) * (c.line - a.line) AND (c.line - a.line) * (b.line - a.line) + (c.sample - a.sample) * (b.sample - a.sample) BETWEEN 0 AND (b.line - a.line) ** 2 + (b.sample - a.sample) ** 2))),
    hull AS (SELECT job_id, abs(sum(part)) / 2 AS area, count(*) AS corners FROM h GROUP BY 1)"""


@query(f"{_CELLS}, k AS (SELECT * FROM s WHERE selected), {_HULL.format(rows='k')} SELECT j.job_id, round(coalesce(area, 0), 6) AS hull_area_px2, CASE WHEN corners IS NULL THEN 1 ELSE corners END::BIGINT AS hull_points FROM (SELECT DISTINCT job_id FROM k) j LEFT JOIN hull ON hull.job_id = j.job_id")
def coverage_hull(spark, d):
    points = _selected(spark, d).where("selected").groupBy("job_id").agg(F.collect_list(F.struct("line", "sample")).alias("pts"))  # at most a point for each cell
    ring = coverage.hull(F.col("pts"))
    return points.select("job_id", ring.alias("ring")).select("job_id", _r(coverage.ring_area(F.col("ring"))).alias("hull_area_px2"), F.size("ring").cast("long").alias("hull_points"))


_SM = f"WITH t AS ({TIE_SQL}), m AS (SELECT job_id, count(*)::BIGINT AS candidates, count(*) FILTER (is_inlier)::BIGINT AS inliers, (count(*) FILTER (is_inlier))::DOUBLE / count(*) AS inlier_ratio, sqrt(avg(residual_px * residual_px) FILTER (is_inlier)) AS rmse_px, quantile_cont(residual_px, 0.5) FILTER (is_inlier) AS median_px, quantile_cont(residual_px, 0.9) FILTER (is_inlier) AS p90_px FROM t GROUP BY job_id)"


@query(f"{_SM} SELECT job_id, candidates, inliers, round(inlier_ratio, 6) AS inlier_ratio, round(rmse_px, 6) AS rmse_px, round(median_px, 6) AS median_px, round(p90_px, 6) AS p90_px FROM m")
def scene_metrics(spark, d):
    rows = gates.scene_metrics(ties(spark, d))
    return rows.select("job_id", "candidates", "inliers", *[_r(F.col(c)).alias(c) for c in ("inlier_ratio", "rmse_px", "median_px", "p90_px")])


_GATES = [(1, "rmse", "hard", "rmse_px", "le", 0.52, False, False), (2, "count", "hard", "inliers", "ge", 8.0, False, False), (3, "ratio", "soft", "inlier_ratio", "gt", 0.7, False, False), (4, "control", "soft", "control", "lt", 1.0, False, True), (5, "route", "soft", "p90_px", "lt", 0.75, True, False)]


def _gate_results(spark, d):
    m = gates.scene_metrics(ties(spark, d))
    ev = m.select(F.col("job_id").alias("scene"), (F.col("job_id") % 11 != 0).alias("route_qualified"), (F.col("job_id") % 3 == 0).alias("has_independent_control"), F.lit(None).cast("double").alias("control_uncertainty_m"), F.create_map(*[x for c in ("rmse_px", "inliers", "inlier_ratio", "p90_px") for x in (F.lit(c), _r(F.col(c).cast("double")))]).alias("metrics"))
    rules = spark.createDataFrame([(*g, False) for g in _GATES], "ord int, name string, kind string, metric_name string, comparison string, threshold double, route_qualification_only boolean, requires_independent_control boolean, requires_absolute_control_uncertainty boolean")
    return gates.evaluate_gates(ev, rules)


_GR = f"""{_SM}, v AS (SELECT job_id AS scene, job_id % 11 <> 0 AS q, job_id % 3 = 0 AS ctl, round(rmse_px, 6) AS rmse, inliers, round(inlier_ratio, 6) AS ratio, round(p90_px, 6) AS p90 FROM m),
    g AS (SELECT scene, q, 1 AS ord, 'rmse' AS name, 'hard' AS kind, coalesce(rmse <= 0.52, false) AS passed FROM v UNION ALL SELECT scene, q, 2, 'count', 'hard', inliers >= 8 FROM v UNION ALL SELECT scene, q, 3, 'ratio', 'soft', ratio > 0.7 FROM v
    UNION ALL SELECT scene, q, 4, 'control', 'soft', CASE WHEN ctl THEN false END FROM v UNION ALL SELECT scene, q, 5, 'route', 'soft', CASE WHEN q THEN coalesce(p90 < 0.75, false) END FROM v)"""


@query(f"{_GR} SELECT scene, name, kind, passed FROM g")
def gate_results(spark, d):
    return _gate_results(spark, d).select("scene", "name", "kind", "passed")


@query(f"""{_GR} SELECT scene, CASE WHEN NOT bool_and(q) THEN 'reject' WHEN bool_or(kind = 'hard' AND NOT coalesce(passed, true)) THEN 'reject' WHEN bool_or(kind = 'soft' AND NOT coalesce(passed, true)) THEN 'review' ELSE 'accept' END AS verdict,
    coalesce(string_agg(name, ';' ORDER BY ord) FILTER (NOT passed), '') AS reason FROM g GROUP BY scene""")
def tie_point_verdicts(spark, d):
    return gates.scene_verdicts(_gate_results(spark, d))


# --- raster ------------------------------------------------------------------------------------------------------


@query(f"WITH p AS ({PIXEL_SQL}) SELECT image_id, (line // 4)::INT AS line, (sample // 4)::INT AS sample, bool_and(valid) AS valid FROM p GROUP BY 1, 2, 3")
def downsampled_mask(spark, d):
    return raster.downsample_mask(pixels(spark, d), 4)


_NB = f"WITH p AS ({PIXEL_SQL}), v AS (SELECT *, CASE WHEN valid THEN value END AS u FROM p), n AS (SELECT *, lag(u) OVER l AS w, lead(u) OVER l AS e, lag(u) OVER s AS n, lead(u) OVER s AS s FROM v WINDOW l AS (PARTITION BY image_id, line ORDER BY sample), s AS (PARTITION BY image_id, sample ORDER BY line))"


_SC = f"""{_NB}, a AS (SELECT *, greatest(abs(u), abs(n), abs(s), abs(w), abs(e)) AS top, u IS NOT NULL AND n IS NOT NULL AND s IS NOT NULL AND w IS NOT NULL AND e IS NOT NULL AS whole FROM n),
    c AS (SELECT image_id, line, sample, u / top AS cc, n / top AS n, s / top AS s, w / top AS w, e / top AS e FROM a WHERE whole), q AS (SELECT *, list_sort([abs(cc - n), abs(cc - s), abs(cc - w), abs(cc - e)]) AS k, sqrt(((e - w) / 2) ** 2 + ((s - n) / 2) ** 2) AS raw FROM c)"""


@query(f"{_SC} SELECT v.image_id, v.line, v.sample, round(least(1, coalesce(raw / nullif(k[3] + 0.85 * (k[4] - k[3]), 0), 0 * raw)), 6) AS magnitude, round(CASE WHEN raw > 1e-12 THEN atan2((s - n) / 2, (e - w) / 2) END, 6) AS orientation FROM v LEFT JOIN q ON q.image_id = v.image_id AND q.line = v.line AND q.sample = v.sample".replace("least(1,", "if(raw IS NULL, NULL, 1) * least(1,"))
def gradient_channels(spark, d):
    return raster.gradients(pixels(spark, d)).select("image_id", "line", "sample", _r(F.col("magnitude")).alias("magnitude"), _r(F.col("orientation")).alias("orientation"))


@query(f"{_SC} SELECT v.image_id, v.line, v.sample, round(CASE WHEN cc IS NOT NULL THEN CASE WHEN list_sum(k) > 2.3e-16 THEN least(1, abs(4 * cc - n - s - w - e) / list_sum(k)) ELSE 0 END END, 6) AS phase FROM v LEFT JOIN q ON q.image_id = v.image_id AND q.line = v.line AND q.sample = v.sample")
def phase_equivalent_channel(spark, d):
    return raster.phase_equivalent(pixels(spark, d)).select("image_id", "line", "sample", _r(F.col("phase")).alias("phase"))


@query(f"WITH p AS ({PIXEL_SQL}), s AS (SELECT image_id, avg(value) FILTER (valid) AS m, stddev_pop(value) FILTER (valid) AS dv FROM p GROUP BY 1) SELECT image_id, line, sample, round(CASE WHEN valid THEN CASE WHEN dv = 0 THEN 0 ELSE (value - m) / dv END END, 5) AS z FROM p JOIN s USING (image_id)")
def normalised_pixels(spark, d):
    return raster.normalise(pixels(spark, d)).select("image_id", "line", "sample", _r(F.col("z"), 5).alias("z"))


@query(f"WITH p AS ({PIXEL_SQL}), s AS (SELECT image_id, quantile_cont(value, 0.02) FILTER (valid) AS l, quantile_cont(value, 0.98) FILTER (valid) AS h FROM p GROUP BY 1) SELECT image_id, line, sample, CASE WHEN valid THEN floor(least(greatest((value - l) / (h - l), 0), 1) * 255.0)::INT ELSE 0 END AS byte FROM p JOIN s USING (image_id)")
def normalised_preview(spark, d):
    return raster.preview(pixels(spark, d)).select("image_id", "line", "sample", "byte")


@query(f"WITH p AS ({PIXEL_SQL}) SELECT image_id, round(quantile_cont(value, 0.05) FILTER (valid), 6) AS p5, round(quantile_cont(value, 0.2) FILTER (valid), 6) AS p20, round(quantile_cont(value, 0.95) FILTER (valid), 6) AS p95, round(quantile_cont(value, 0.5) FILTER (valid), 6) AS median FROM p GROUP BY 1")
def shadow_statistics(spark, d):
    return raster.shadow_statistics(pixels(spark, d)).select("image_id", *[_r(F.col(c)).alias(c) for c in ("p5", "p20", "p95", "median")])


@query(f"WITH p AS ({PIXEL_SQL}), q AS (SELECT a.line, a.value AS x, b.value AS y FROM p a JOIN p b ON b.line = a.line + 1 AND b.sample = a.sample) SELECT line, round(corr(x, y), 6) AS ncc FROM q GROUP BY line")
def ncc_scores(spark, d):
    p = pixels(spark, d).select("line", "sample", "value")
    q = p.select((F.col("line") - 1).alias("line"), "sample", F.col("value").alias("y"))
    return raster.ncc(p.join(q, ["line", "sample"]), ["line"], F.col("value"), F.col("y")).select("line", _r(F.col("ncc")).alias("ncc"))


# --- pyramids ----------------------------------------------------------------------------------------------------


def dense_pixels(spark: SparkSession, d: str) -> DataFrame:
    """pixels with lines numbered from 0 within each image."""
    e = _t(spark, d, "embeddings").select(F.col("label").cast("long").alias("image_id"), "vec_id", "embedding")
    e = e.withColumn("line", F.row_number().over(Window.partitionBy("image_id").orderBy("vec_id")).cast("long") - 1)
    rows = e.select("image_id", "line", F.posexplode("embedding").alias("sample", "v"))
    return rows.select("image_id", "line", F.col("sample").cast("long"), F.col("v").cast("double").alias("value"), (F.col("v") > -0.15).alias("valid"))


_DENSE = """d AS (SELECT image_id, line, cast(p - 1 AS bigint) AS sample, cast(embedding[p] AS double) AS value, embedding[p] > -0.15 AS valid
    FROM (SELECT cast(label AS bigint) AS image_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS line, embedding, unnest(range(1, 65)) AS p FROM embeddings)),
    h AS (SELECT image_id, max(line) + 1 AS h, max(sample) + 1 AS w FROM d GROUP BY 1)"""


def _blur_sql(sigma: float) -> str:
    """Table b: d blurred, by joins with a kernel table and clamped positions."""
    k = pyramid.kernel(sigma)
    rows = ", ".join(f"({i}, {k[abs(i)]!r})" for i in range(1 - len(k), len(k)))
    return f"""k(i, g) AS (VALUES {rows}),
    a AS (SELECT d.image_id, d.line, d.sample, d.valid, sum(g * o.value) AS value FROM d JOIN h USING (image_id) CROSS JOIN k JOIN d o ON o.image_id = d.image_id AND o.line = d.line AND o.sample = least(greatest(d.sample + i, 0), w - 1) GROUP BY ALL),
    b AS (SELECT a.image_id, a.line, a.sample, a.valid, sum(g * o.value) AS value FROM a JOIN h USING (image_id) CROSS JOIN k JOIN a o ON o.image_id = a.image_id AND o.sample = a.sample AND o.line = least(greatest(a.line + i, 0), h - 1) GROUP BY ALL)"""


@query(f"WITH {_DENSE}, {_blur_sql(1.0)} SELECT image_id, line, sample, round(value, 6) AS value FROM b")
def blurred_pixels(spark, d):
    return pyramid.gaussian_blur(dense_pixels(spark, d), 1.0).select("image_id", "line", "sample", _r(F.col("value")).alias("value"))


@query(f"""WITH {_DENSE}, {_blur_sql(0.5 * 3**0.5)}, m AS (SELECT image_id, line // 2 AS line, sample // 2 AS sample, bool_and(valid) AS valid FROM d GROUP BY 1, 2, 3)
    SELECT m.image_id, m.line, m.sample, round(b.value, 6) AS value, m.valid FROM m JOIN b ON b.image_id = m.image_id AND b.line = 2 * m.line AND b.sample = 2 * m.sample""")
def common_resolution_level(spark, d):
    return pyramid.decimate(dense_pixels(spark, d), 2.6).select("image_id", "line", "sample", _r(F.col("value")).alias("value"), "valid")


@query("SELECT p_partkey AS pair, l::INT AS level, greatest(p_size * 0.5e0, p_partkey % 7 + 0.25e0) * 2 ** l AS level_gsd_m FROM part, range(4) t(l)")
def paired_pyramid_levels(spark, d):
    pairs = _t(spark, d, "part").selectExpr("p_partkey AS pair", "p_size * 0.5D AS gsd_m", "p_partkey % 7 + 0.25D AS reference_gsd_m")
    return pyramid.pyramid_levels(pairs, 4).select("pair", "level", "level_gsd_m")


def _axis_sql(name: str, n_in: str, n_out: int) -> str:
    x = f"least(greatest((o + 0.5e0) * {n_in} / {n_out} - 0.5e0, 0), {n_in} - 1)"
    return f"{name} AS (SELECT image_id, o, floor(x)::BIGINT AS lo, least(floor(x)::BIGINT + 1, n - 1) AS hi, x - floor(x) AS f FROM (SELECT image_id, o, {x} AS x, {n_in} AS n FROM h, range({n_out}) t(o)))"


@query(f"""WITH {_DENSE}, {_axis_sql("y", "h", 24)}, {_axis_sql("x", "w", 40)}
    SELECT y.image_id, y.o AS line, x.o AS sample, round((1 - y.f) * ((1 - x.f) * a.value + x.f * b.value) + y.f * ((1 - x.f) * c.value + x.f * e.value), 6) AS value
    FROM y JOIN x USING (image_id) JOIN d a ON a.image_id = y.image_id AND a.line = y.lo AND a.sample = x.lo JOIN d b ON b.image_id = y.image_id AND b.line = y.lo AND b.sample = x.hi
    JOIN d c ON c.image_id = y.image_id AND c.line = y.hi AND c.sample = x.lo JOIN d e ON e.image_id = y.image_id AND e.line = y.hi AND e.sample = x.hi""")
def bilinear_resize(spark, d):
    return pyramid.resize_bilinear(dense_pixels(spark, d), 24, 40).select("image_id", F.col("line").cast("long"), F.col("sample").cast("long"), _r(F.col("value")).alias("value"))


@query(f"""WITH {_DENSE} SELECT d.image_id, y.o AS line, x.o AS sample, bool_and(valid) AS valid FROM d JOIN h USING (image_id), range(3) y(o), range(40) x(o)
    WHERE d.line * 3 < (y.o + 1) * h AND (d.line + 1) * 3 > y.o * h AND d.sample * 40 < (x.o + 1) * w AND (d.sample + 1) * 40 > x.o * w GROUP BY 1, 2, 3""")
def resampled_mask(spark, d):
    return pyramid.resample_mask(dense_pixels(spark, d), 3, 40)


@query(f"WITH {_DENSE} SELECT image_id, line, sample, valid AND value < 0.15 AND sample % 16 < 15 AS eligible FROM d")
def eligibility_masks(spark, d):
    p = dense_pixels(spark, d)
    return pyramid.combine_masks(p, p.withColumn("valid", F.col("value") < 0.15), p.withColumn("valid", F.col("sample") % 16 < 15))


@query(f"""WITH {_DENSE}, n AS (SELECT d.image_id, d.line, d.sample, d.value, d.valid, o.value AS v, o.valid AS ok FROM d JOIN d o ON o.image_id = d.image_id AND o.line BETWEEN d.line - 2 AND d.line + 2 AND o.sample BETWEEN d.sample - 2 AND d.sample + 2),
    m AS (SELECT image_id, line, sample, value, valid, median(v) FILTER (ok) AS m, count(*) AS area, count(*) FILTER (ok) AS support FROM n GROUP BY ALL),
    a AS (SELECT m.*, (SELECT 1.4826 * median(abs(o.value - m.m)) FROM d o WHERE o.image_id = m.image_id AND o.valid AND o.line BETWEEN m.line - 2 AND m.line + 2 AND o.sample BETWEEN m.sample - 2 AND m.sample + 2) AS mad FROM m)
    SELECT image_id, line, sample, round(CASE WHEN valid AND support >= greatest(9, ceil(area * 0.5)) THEN CASE WHEN mad <= 1e-12 THEN 0 ELSE greatest(-1, least(1, (value - m) / mad / 3)) END END, 6) AS radiometry FROM a""")
def local_radiometry(spark, d):
    return pyramid.local_radiometry(dense_pixels(spark, d), 5).select("image_id", "line", "sample", _r(F.col("radiometry")).alias("radiometry"))


# --- geometry ----------------------------------------------------------------------------------------------------

_PT = "SELECT o_orderkey AS id, (o_orderkey * 7 % 1800) / 10.0e0 - 90 AS lat, (o_custkey * 31 % 7200) / 10.0e0 - 360 AS lon FROM orders"


@query(f"WITH p AS ({_PT}), q AS (SELECT *, sin(radians((10 - lat)) / 2) ** 2 + cos(radians(lat)) * cos(radians(10)) * sin(radians(20 - lon) / 2) ** 2 AS a FROM p) SELECT id, round(2 * 1737400.0 * asin(sqrt(least(1.0, a))), 2) AS distance_m, round(lon - 360 * floor((lon + 180) / 360), 6) AS lon FROM q")
def ground_distances(spark, d):
    p = _t(spark, d, "orders").selectExpr("o_orderkey AS id", "(o_orderkey * 7 % 1800) / 10.0D - 90 AS lat", "(o_custkey * 31 % 7200) / 10.0D - 360 AS lon")
    return p.select("id", _r(geo.ground_distance(F.col("lat"), F.col("lon"), F.lit(10.0), F.lit(20.0)), 2).alias("distance_m"), _r(geo.normalize_longitude(F.col("lon"))).alias("lon"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity + 1 AS xx, l_discount * 5 AS xy, l_tax * 50 + 1 AS yy FROM lineitem), e AS (SELECT *, (xx + yy) / 2 + sqrt(((xx - yy) / 2) ** 2 + xy ** 2) AS big, (xx + yy) / 2 - sqrt(((xx - yy) / 2) ** 2 + xy ** 2) AS small FROM c)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(big, 6) AS big, round(small, 6) AS small, round(CASE WHEN small > 0 THEN sqrt(big / small) END, 5) AS anisotropy, round(degrees(atan2(2 * xy, xx - yy) / 2), 5) AS orientation FROM e""")
def covariance_ellipses(spark, d):
    c = _t(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity + 1 AS xx", "l_discount * 5 AS xy", "l_tax * 50 + 1 AS yy")
    xx, xy, yy = F.col("xx"), F.col("xy"), F.col("yy")
    big, small = geo.eigenvalues(xx, xy, yy)
    return c.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", _r(big).alias("big"), _r(small).alias("small"), _r(geo.anisotropy(xx, xy, yy), 5).alias("anisotropy"), _r(geo.orientation_deg(xx, xy, yy), 5).alias("orientation"))


_NORMAL = """l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS a, l_discount * 20 AS b, l_discount * 20 + CASE WHEN l_linenumber = 7 THEN 0.1 ELSE 0 END AS c,
    l_tax * 100 - 0.5 AS d, l_extendedprice / 100000 AS v, CASE WHEN l_linenumber % 2 = 0 THEN 1.5 END AS scale"""


@query(f"""WITH m AS (SELECT {_NORMAL} FROM lineitem), e AS (SELECT *, (b + c) / 2 AS o, a * d - b * c AS det FROM m), g AS (SELECT *, abs((a + d) / 2 + sqrt(((a - d) / 2) ** 2 + o ** 2)) AS l1, abs((a + d) / 2 - sqrt(((a - d) / 2) ** 2 + o ** 2)) AS l2 FROM e),
    w AS (SELECT *, l_linenumber <> 7 AND greatest(l1, l2) <= 30 * least(l1, l2) AND v * d / det > 0 AND v * a / det > 0 AND det > 0 AS ok, coalesce(scale, 1.0) AS f FROM g)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN ok THEN f * v * d / det END, 6) AS xx, round(CASE WHEN ok THEN -f * v * o / det END, 6) AS xy, round(CASE WHEN ok THEN f * v * a / det END, 6) AS yy,
    CASE WHEN ok THEN scale IS NOT NULL END AS calibrated FROM w""")
def refined_covariances(spark, d):
    m = _t(spark, d, "lineitem").selectExpr(*[c.strip() for c in _NORMAL.split(",")])
    m = m.withColumn("k", geo.hessian_covariance(*map(F.col, "abcdv"), 30.0, F.col("scale").cast("double")))
    return m.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[_r(F.col(f"k.{c}")).alias(c) for c in ("xx", "xy", "yy")], "k.calibrated")


# --- governance --------------------------------------------------------------------------------------------------

_PROD = "SELECT doc_id AS product_id, doc_id % 97 AS terrain_group, CASE lang WHEN 'en' THEN 'development' WHEN 'fr' THEN 'validation' WHEN 'de' THEN 'held_out' ELSE 'not_applicable' END AS split_role FROM documents"


_SPLITS = ("development", "validation", "held_out")


def _products(spark, d):
    return _t(spark, d, "documents").selectExpr("doc_id AS product_id", "doc_id AS ordinal", "doc_id % 97 AS terrain_group", "CASE lang WHEN 'en' THEN 'development' WHEN 'fr' THEN 'validation' WHEN 'de' THEN 'held_out' ELSE 'not_applicable' END AS split_role")


@query(f"WITH p AS ({_PROD}) SELECT terrain_group, string_agg(DISTINCT split_role, ',' ORDER BY split_role) FILTER (split_role <> 'not_applicable') AS splits, min(product_id) AS first_seen, count(*) FILTER (split_role <> 'not_applicable') AS products FROM p GROUP BY 1 HAVING count(DISTINCT split_role) FILTER (split_role <> 'not_applicable') >= 2")
def split_leakage(spark, d):
    return governance.split_leakage(_products(spark, d), _SPLITS)


@query("""WITH f AS (SELECT doc_id, sha256(text) AS sha, strlen(text) AS n FROM documents), m AS (SELECT doc_id AS path, CASE WHEN doc_id % 13 = 0 THEN 'x' || sha ELSE sha END AS ms, n + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS mn FROM f WHERE doc_id % 17 <> 3), g AS (SELECT doc_id AS path, sha AS fs, n AS fn FROM f WHERE doc_id % 19 <> 5)
    SELECT path, CASE WHEN fs IS NULL THEN 'missing' WHEN ms IS NULL THEN 'unknown' WHEN mn <> fn THEN 'size_mismatch' WHEN ms <> fs THEN 'checksum_mismatch' ELSE 'ok' END AS status FROM m FULL JOIN g USING (path)""")
def manifest_integrity(spark, d):
    f = _t(spark, d, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("size"))
    m = f.where("path % 17 <> 3").select("path", F.when(F.col("path") % 13 == 0, F.concat(F.lit("x"), "sha256")).otherwise(F.col("sha256")).alias("sha256"), (F.col("size") + (F.col("path") % 7 == 0).cast("int")).alias("size"))
    return governance.manifest_integrity(m, f.where("path % 19 <> 5"))


@query("""SELECT source, sha256('["' || string_agg(sha256(text), '","' ORDER BY sha256(text)) || '"]') AS digest FROM documents GROUP BY source""")
def combined_digests(spark, d):
    return hashing.digest_many(_t(spark, d, "documents").select("source", F.sha2("text", 256).alias("h")), "source", "h")


@query("SELECT o_orderkey AS id, o_custkey AS owner FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def dangling_references(spark, d):
    owners = _t(spark, d, "customer").where("c_mktsegment <> 'BUILDING'")
    return governance.dangling(runs(spark, d), "owner", owners, "c_custkey").select("id", "owner")


_KERNEL = """SELECT CASE WHEN doc_id % 29 = 0 THEN '/k' || doc_id WHEN doc_id % 31 = 0 THEN 'k' || (doc_id - 1) ELSE 'k' || doc_id END AS name, CASE WHEN doc_id % 23 = 0 THEN 'none' ELSE {sha} END AS sha256,
    CASE WHEN doc_id % 11 = 0 THEN 10 ELSE 0 END AS start_utc, 5 + doc_id % 90 AS stop_utc, doc_id % 7 AS priority, CASE WHEN doc_id % 19 = 0 THEN 'draft' WHEN doc_id % 2 = 0 THEN 'predicted' ELSE 'reconstructed' END AS status FROM documents"""
_KERNEL_FILE = "SELECT 'k' || doc_id AS name, CASE WHEN doc_id % 13 = 0 THEN 'other' ELSE {sha} END AS sha256 FROM documents WHERE doc_id % 17 <> 3"
_SHA = "sha256('b' || doc_id)"


@query(f"""WITH e AS ({_KERNEL.format(sha=_SHA)}), f AS ({_KERNEL_FILE.format(sha=_SHA)}), n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY priority DESC, sha256, start_utc, stop_utc, status) AS nth FROM e)
    SELECT n.name, n.priority, n.nth, CASE WHEN n.name LIKE '/%' THEN 'input.hostile_label' WHEN nth > 1 OR length(n.sha256) <> 64 OR status = 'draft' THEN 'input.label_unparseable' WHEN f.name IS NULL THEN 'input.missing_file'
    WHEN f.sha256 <> n.sha256 THEN 'input.checksum_mismatch' WHEN start_utc > stop_utc OR start_utc > 5 OR stop_utc < 20 THEN 'geometry.kernel_coverage_gap' END AS code FROM n LEFT JOIN f ON f.name = n.name""")
def kernel_inventory(spark, d):
    docs = _t(spark, d, "documents")
    sha, name = F.sha2(F.concat(F.lit("b"), "doc_id").cast("binary"), 256), lambda x: F.concat(F.lit("k"), x)
    i = F.col("doc_id")
    entries = docs.select(
        F.when(i % 29 == 0, F.concat(F.lit("/k"), i)).when(i % 31 == 0, name(i - 1)).otherwise(name(i)).alias("name"), F.when(i % 23 == 0, "none").otherwise(sha).alias("sha256"),
        F.when(i % 11 == 0, 10).otherwise(0).alias("start_utc"), (i % 90 + 5).alias("stop_utc"), (i % 7).alias("priority"),
        F.when(i % 19 == 0, "draft").when(i % 2 == 0, "predicted").otherwise("reconstructed").alias("status"),
    )
    files = docs.where(i % 17 != 3).select(name(i).alias("name"), F.when(i % 13 == 0, "other").otherwise(sha).alias("sha256"))
    found = governance.kernel_inventory(entries, files, F.lit(5), F.lit(20))
    nth = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("priority"), "sha256", "start_utc", "stop_utc", "status"))
    return found.withColumn("nth", nth).select("name", "priority", "nth", "code")


# --- matchers ----------------------------------------------------------------------------------------------------

_NCC = f"""WITH {_DENSE}, r AS (SELECT image_id, line + 1 AS line, sample + 2 AS sample, value + (line * 7 + sample * 3) % 5 * 0.01 AS value, valid FROM d),
    t AS (SELECT t.image_id, t.line, t.sample, o.line - t.line AS dy, o.sample - t.sample AS dx, o.value AS a, o.valid AS ok FROM d t JOIN d o ON o.image_id = t.image_id AND o.line BETWEEN t.line - 2 AND t.line + 2
        AND o.sample BETWEEN t.sample - 2 AND t.sample + 2 WHERE t.line % 8 = 0 AND t.sample % 8 = 0),
    k AS (SELECT image_id, line, sample FROM t GROUP BY ALL HAVING count(*) = 25 AND count(*) FILTER (ok) > 12.5),
    c AS (SELECT k.*, k.line + y AS rl, k.sample + x AS rs FROM k, range(-3, 4) a(y), range(-3, 4) b(x) WHERE y * y + x * x <= 9),
    s AS (SELECT c.image_id, c.line, c.sample, rl, rs, corr(a, r.value) FILTER (ok AND r.valid) AS score FROM c JOIN t USING (image_id, line, sample) JOIN r ON r.image_id = c.image_id AND r.line = rl + dy AND r.sample = rs + dx
        GROUP BY ALL HAVING count(*) = 25 AND count(*) FILTER (ok AND r.valid) > 12.5),
    b AS (SELECT image_id, line, sample, max(score) AS best, arg_max(rl, score) AS bl, arg_max(rs, score) AS bs FROM s WHERE score IS NOT NULL GROUP BY 1, 2, 3),
    g AS (SELECT b.*, max(s.score) FILTER (greatest(abs(rl - bl), abs(rs - bs)) > 1) AS far, avg(s.score) FILTER (greatest(abs(rl - bl), abs(rs - bs)) = 1) AS near FROM b JOIN s USING (image_id, line, sample) GROUP BY ALL)
    SELECT k.image_id, k.line, k.sample, coalesce(bl, k.line)::DOUBLE AS ref_line, coalesce(bs, k.sample)::DOUBLE AS ref_sample, round(coalesce(best, -1), 6) AS score, best IS NOT NULL AS is_candidate, round(CASE WHEN best > 0 THEN
    least(coalesce(least(greatest((best - far) / best, 0), 1), 0), coalesce(least(greatest((best - near) / best, 0), 1), 0)) WHEN best IS NOT NULL THEN 0 END, 6) AS agreement FROM k LEFT JOIN g USING (image_id, line, sample)"""


@query(_NCC)
def ncc_search(spark, d):
    p = dense_pixels(spark, d)
    moved = p.select("image_id", (F.col("line") + 1).alias("line"), (F.col("sample") + 2).alias("sample"), (F.col("value") + (F.col("line") * 7 + F.col("sample") * 3) % 5 * 0.01).alias("value"), "valid")
    return matching.ncc_search(p, moved, 8, 2, 3.0).withColumns({c: _r(F.col(c)) for c in ("score", "agreement")})
