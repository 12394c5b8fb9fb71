"""Queries of benchmark governance, stages and routes over the test tables, each with its SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from veldspar.operators import governance, routes
from veldspar.plans.registry import _PROD, _SPLITS, _products, _r, _t, query

# --- splits and reports ------------------------------------------------------------------------------------------


@query(f"WITH p AS ({_PROD}), k AS (SELECT terrain_group FROM p WHERE split_role <> 'not_applicable' GROUP BY 1 HAVING count(DISTINCT split_role) >= 2) SELECT DISTINCT terrain_group, product_id FROM p WHERE split_role <> 'not_applicable' AND terrain_group IN (SELECT terrain_group FROM k)")
def leaking_products(spark, d):
    return governance.leaking_products(_products(spark, d), _SPLITS)


_LOOSE = "SELECT CASE WHEN doc_id % 50 = 3 THEN 7 ELSE doc_id END AS product_id, doc_id AS ordinal, CASE WHEN doc_id % 11 > 0 THEN 'g' || doc_id END AS terrain_group, CASE lang WHEN 'en' THEN 'development' WHEN 'fr' THEN 'validation' WHEN 'de' THEN 'held_out' ELSE 'not_applicable' END AS split_role, CASE WHEN doc_id % 2 = 0 THEN 'source' ELSE 'reference' END AS role FROM documents"


@query(f"""WITH p AS ({_LOOSE}) SELECT 'repeated_product_id' AS rule, product_id::VARCHAR AS subject FROM p GROUP BY product_id HAVING count(*) > 1 UNION ALL SELECT 'ungrouped_source', product_id::VARCHAR FROM p WHERE role = 'source' AND split_role <> 'not_applicable' AND terrain_group IS NULL""")
def split_violations(spark, d):
    cols = _LOOSE.removeprefix("SELECT ").removesuffix(" FROM documents").split(", ")
    return governance.split_violations(_t(spark, d, "documents").selectExpr(*cols), _SPLITS)


_SCENES = "SELECT o_custkey % 40 AS report_id, CASE WHEN o_orderkey % 97 = 1 THEN o_custkey % 40 ELSE o_orderkey + 1000 END AS product_id, CASE WHEN o_orderkey % 5 = 0 THEN 'held_out_test' ELSE 'development' END AS split_role, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'rejected' ELSE 'failed' END AS outcome, o_orderkey AS k FROM orders"
_CHECKS = "SELECT report_id, CASE WHEN k % 83 = 0 THEN 'same' ELSE 'c' || k END AS checkpoint_id, product_id AS scene_product_id, CASE k % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'excluded' ELSE 'unresolved' END AS status FROM s WHERE (split_role = 'held_out_test' AND k % 7 > 0) OR k % 61 = 0"
_COUNTED = """n AS (SELECT s.report_id, count(*) AS total_scenes, count(*) FILTER (outcome = 'succeeded') AS succeeded, count(*) FILTER (outcome = 'rejected') AS rejected, count(*) FILTER (outcome = 'failed') AS failed, 0::BIGINT AS cancelled FROM s GROUP BY 1),
    h AS (SELECT report_id, count(*) AS checkpoints, count(*) FILTER (status = 'accepted') AS checkpoints_accepted, count(*) FILTER (status = 'excluded') AS checkpoints_excluded, count(*) FILTER (status = 'unresolved') AS checkpoints_unresolved FROM c GROUP BY 1)"""


def _report(spark, d):
    scenes = _t(spark, d, "orders").selectExpr("o_custkey % 40 AS report_id", "CASE WHEN o_orderkey % 97 = 1 THEN o_custkey % 40 ELSE o_orderkey + 1000 END AS product_id", "CASE WHEN o_orderkey % 5 = 0 THEN 'held_out_test' ELSE 'development' END AS split_role", "CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'rejected' ELSE 'failed' END AS outcome", "o_orderkey AS k")
    checks = scenes.where("(split_role = 'held_out_test' AND k % 7 > 0) OR k % 61 = 0").selectExpr("report_id", "CASE WHEN k % 83 = 0 THEN 'same' ELSE 'c' || k END AS checkpoint_id", "product_id AS scene_product_id", "CASE k % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'excluded' ELSE 'unresolved' END AS status")
    return scenes, checks


@query(f"WITH s AS ({_SCENES}), c AS ({_CHECKS}), {_COUNTED} SELECT n.*, coalesce(checkpoints, 0) AS checkpoints, coalesce(checkpoints_accepted, 0) AS checkpoints_accepted, coalesce(checkpoints_excluded, 0) AS checkpoints_excluded, coalesce(checkpoints_unresolved, 0) AS checkpoints_unresolved FROM n LEFT JOIN h ON h.report_id = n.report_id")
def benchmark_run_counts(spark, d):
    return governance.run_counts(*_report(spark, d))


@query(f"""WITH s AS ({_SCENES}), c AS ({_CHECKS}), {_COUNTED}, held AS (SELECT DISTINCT report_id, product_id FROM s WHERE split_role = 'held_out_test'), tune AS (SELECT report_id, product_id FROM s WHERE k % 35 = 0),
    per AS (SELECT held.report_id, held.product_id, count(checkpoint_id) AS m FROM held LEFT JOIN c ON c.report_id = held.report_id AND c.scene_product_id = held.product_id GROUP BY 1, 2)
    SELECT report_id, 'repeated_scene' AS rule, product_id::VARCHAR AS subject FROM s GROUP BY report_id, product_id HAVING count(*) > 1 UNION ALL SELECT report_id, 'repeated_checkpoint', checkpoint_id FROM c GROUP BY report_id, checkpoint_id HAVING count(*) > 1
    UNION ALL SELECT DISTINCT report_id, 'held_out_scene_tuned_on', product_id::VARCHAR FROM held WHERE (report_id, product_id) IN (SELECT report_id, product_id FROM tune) UNION ALL SELECT DISTINCT report_id, 'checkpoint_not_held_out', checkpoint_id FROM c WHERE (report_id, scene_product_id) NOT IN (SELECT report_id, product_id FROM held)
    UNION ALL SELECT report_id, 'held_out_scene_needs_one_checkpoint', product_id::VARCHAR FROM per WHERE m <> 1 UNION ALL SELECT report_id, 'summary_differs', 'summary' FROM n WHERE report_id % 9 = 4""")
def report_violations(spark, d):
    scenes, checks = _report(spark, d)
    stated = governance.run_counts(scenes, checks).withColumn("succeeded", F.col("succeeded") + (F.col("report_id") % 9 == 4).cast("int"))
    return governance.report_violations(scenes, checks, scenes.where("k % 35 = 0").select("report_id", "product_id"), stated)


_REVIEW = """o_orderkey AS id, o_custkey % 5 AS r1, (o_custkey + o_orderkey) % 5 AS r2, CASE WHEN o_orderkey % 3 = 0 THEN 'exclude' ELSE 'accept' END AS d1, CASE WHEN o_orderkey % 4 = 0 THEN 'unresolved' ELSE 'accept' END AS d2,
    o_custkey % 41 = 0 AS scene_tuned_on, o_orderkey % 29 <> 0 AS truth, CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 7 END AS resolver, CASE o_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'accept' WHEN 2 THEN 'accept' WHEN 3 THEN NULL WHEN 4 THEN 'exclude' ELSE 'unresolved' END AS resolution,
    CASE o_orderkey % 7 WHEN 0 THEN 'excluded' WHEN 1 THEN 'unresolved' ELSE 'accepted' END AS status, CASE WHEN o_orderkey % 31 > 0 THEN 'held_out_test' END AS split, o_orderkey % 37 > 0 AS in_report, o_orderkey % 11 > 0 AS agrees"""


@query(f"""WITH q AS (SELECT {_REVIEW} FROM orders), x AS (SELECT *, d1 <> d2 AS differ, CASE CASE WHEN d1 <> d2 THEN resolution ELSE d1 END WHEN 'accept' THEN 'accepted' WHEN 'exclude' THEN 'excluded' WHEN 'unresolved' THEN 'unresolved' END AS due FROM q)
    SELECT id, CASE WHEN r1 = r2 THEN 'reviewers_not_two_people' WHEN r1 = 4 OR r2 = 4 THEN 'reviewer_tuned_the_route' WHEN scene_tuned_on THEN 'scene_used_for_tuning' WHEN differ <> (differ = truth) THEN 'disagreement_misstated' WHEN differ AND resolution IS NULL THEN 'resolution_missing'
    WHEN differ AND (resolver IN (r1, r2) OR resolver IN (4, 6)) THEN 'resolver_not_independent' WHEN NOT differ AND resolution IS NOT NULL THEN 'resolution_without_disagreement' WHEN coalesce(status <> due, true) THEN 'status_differs_from_decision' WHEN split IS NULL THEN 'scene_not_held_out'
    WHEN NOT in_report THEN 'absent_from_report' WHEN NOT agrees THEN 'report_disagrees' END AS violation FROM x""")
def checkpoint_rules(spark, d):
    q = _t(spark, d, "orders").selectExpr(*[c.strip() for c in _REVIEW.replace("AS split,", "AS report_split_role,").split(",")])
    rows = q.select(
        "id", F.array(F.struct(F.col("r1").alias("reviewer_id"), F.col("d1").alias("decision")), F.struct(F.col("r2").alias("reviewer_id"), F.col("d2").alias("decision"))).alias("reviewers"), F.array(F.lit(4), F.lit(6)).cast("array<bigint>").alias("tuning_actor_ids"),
        "scene_tuned_on", ((F.col("d1") != F.col("d2")) == F.col("truth")).alias("disagreement_present"), F.col("resolver").cast("long").alias("resolver_id"), "resolution", "status", "report_split_role", "in_report", F.col("agrees").alias("report_agrees"),
    )
    return governance.checkpoint_rules(rows).select("id", "violation")


@query("""WITH m AS (SELECT p_partkey AS product_id, CASE p_size % 3 WHEN 0 THEN 'development' WHEN 1 THEN 'validation' ELSE 'held_out_test' END AS role FROM part), i AS (SELECT l_orderkey AS fit_id, l_partkey AS product_id, CASE l_linenumber % 3 WHEN 0 THEN 'development' WHEN 1 THEN 'validation' ELSE 'held_out_test' END AS split_role FROM lineitem),
    n AS (SELECT i.*, role, count(*) OVER (PARTITION BY fit_id, i.product_id) AS n FROM i LEFT JOIN m ON m.product_id = i.product_id), x AS (SELECT fit_id, product_id, CASE WHEN n > 1 THEN 'repeated_input' WHEN role IS DISTINCT FROM split_role THEN 'role_differs_from_manifest' WHEN role = 'held_out_test' THEN 'split_not_for_fitting' END AS rule FROM n)
    SELECT DISTINCT * FROM x WHERE rule IS NOT NULL""")
def fit_violations(spark, d):
    role = lambda c: F.when(F.expr(c) % 3 == 0, "development").when(F.expr(c) % 3 == 1, "validation").otherwise("held_out_test")
    products = _t(spark, d, "part").select(F.col("p_partkey").alias("product_id"), role("p_size").alias("split_role"))
    inputs = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("fit_id"), F.col("l_partkey").alias("product_id"), role("l_linenumber").alias("split_role"))
    return governance.fit_violations(inputs, products)


_CLAIM = {
    "claims": "SELECT CASE WHEN l_orderkey % 91 = 0 THEN 'same' ELSE 'k' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey END AS claim_id, l_suppkey AS report_id, l_partkey AS checkpoint_id, l_partkey % 7 AS scene_product_id, CASE WHEN l_linenumber = 7 THEN 'other' ELSE 'rmse' END AS metric_key, l_suppkey + l_partkey % 7 + CASE WHEN l_linenumber = 6 THEN 1 ELSE 0 END AS value, 'px' AS unit, l_suppkey + l_partkey % 7 + CASE WHEN l_linenumber IN (5, 6) THEN 1 ELSE 0 END AS ref_value, CASE WHEN l_linenumber = 4 THEN 'm' ELSE 'px' END AS ref_unit FROM lineitem",
    "reports": "SELECT s_suppkey AS report_id, s_suppkey % 6 AS manifest_id, s_suppkey % 8 <> 3 AS has_fit FROM supplier WHERE s_suppkey % 10 <> 1",
    "checkpoints": "SELECT p_partkey AS checkpoint_id, CASE WHEN p_partkey % 4 < 3 THEN p_partkey % 100 + 1 ELSE 5 END AS report_id, CASE WHEN p_partkey % 9 = 1 THEN 8 ELSE p_partkey % 7 END AS scene_product_id, CASE WHEN p_size > 8 THEN 'accepted' ELSE 'excluded' END AS status FROM part WHERE p_partkey % 13 <> 0",
    "metrics": "SELECT s_suppkey AS report_id, n_nationkey AS scene_product_id, 'rmse' AS metric_key, s_suppkey + n_nationkey AS value, 'px' AS unit FROM supplier, nation WHERE n_nationkey < 6",
    "manifests": "SELECT n_nationkey AS manifest_id FROM nation WHERE n_nationkey < 5",
}


@query(f"""WITH {', '.join(f'{n} AS ({q})' for n, q in _CLAIM.items())}, x AS (SELECT claims.*, reports.has_fit, reports.manifest_id, c.report_id AS c_report, c.scene_product_id AS c_scene, c.status, m.value AS m_value, m.unit AS m_unit, f.manifest_id AS listed, count(*) OVER (PARTITION BY claims.claim_id) AS n
        FROM claims LEFT JOIN reports ON reports.report_id = claims.report_id LEFT JOIN checkpoints c ON c.checkpoint_id = claims.checkpoint_id LEFT JOIN metrics m ON m.report_id = claims.report_id AND m.scene_product_id = claims.scene_product_id AND m.metric_key = claims.metric_key LEFT JOIN manifests f ON f.manifest_id = reports.manifest_id)
    SELECT claim_id, report_id, CASE WHEN n > 1 THEN 'repeated_claim' WHEN has_fit IS NULL THEN 'report_missing' WHEN c_report IS NULL THEN 'checkpoint_missing' WHEN c_report <> report_id THEN 'checkpoint_of_another_report' WHEN status <> 'accepted' THEN 'checkpoint_not_accepted' WHEN c_scene <> scene_product_id THEN 'scene_not_the_checkpoints'
    WHEN value <> ref_value OR unit <> ref_unit THEN 'claim_differs_from_reference' WHEN scene_product_id >= 6 THEN 'scene_not_in_report' WHEN m_value IS NULL THEN 'metric_missing' WHEN m_value <> ref_value OR m_unit <> ref_unit THEN 'metric_differs' WHEN NOT has_fit THEN 'fit_provenance_missing' WHEN listed IS NULL THEN 'manifest_missing' END AS violation FROM x""")
def claim_violations(spark, d):
    li = _t(spark, d, "lineitem")
    cols = ["CASE WHEN l_orderkey % 91 = 0 THEN 'same' ELSE 'k' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey END AS claim_id", "l_suppkey AS report_id", "l_partkey AS checkpoint_id", "l_partkey % 7 AS scene_product_id", "CASE WHEN l_linenumber = 7 THEN 'other' ELSE 'rmse' END AS metric_key"]
    at = "l_suppkey + l_partkey % 7 + CASE WHEN l_linenumber IN ({}) THEN 1 ELSE 0 END AS {}"
    claims = li.selectExpr(*cols, at.format("6", "value"), "'px' AS unit", at.format("5, 6", "ref_value"), "CASE WHEN l_linenumber = 4 THEN 'm' ELSE 'px' END AS ref_unit")
    reports = _t(spark, d, "supplier").where("s_suppkey % 10 <> 1").selectExpr("s_suppkey AS report_id", "s_suppkey % 6 AS manifest_id", "s_suppkey % 8 <> 3 AS has_fit")
    checks = _t(spark, d, "part").where("p_partkey % 13 <> 0").selectExpr("p_partkey AS checkpoint_id", "CASE WHEN p_partkey % 4 < 3 THEN p_partkey % 100 + 1 ELSE 5 END AS report_id", "CASE WHEN p_partkey % 9 = 1 THEN 8 ELSE p_partkey % 7 END AS scene_product_id", "CASE WHEN p_size > 8 THEN 'accepted' ELSE 'excluded' END AS status")
    six = spark.range(6).select(F.col("id").alias("scene_product_id"))
    metrics = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("report_id")).join(F.broadcast(six)).selectExpr("report_id", "scene_product_id", "'rmse' AS metric_key", "report_id + scene_product_id AS value", "'px' AS unit")
    return governance.claim_violations(claims, reports, checks, metrics, spark.range(5).select(F.col("id").alias("manifest_id")))


@query("SELECT p_partkey AS product_id, CASE WHEN p_size % 5 = 0 THEN 'failed' WHEN p_size > 25 THEN 'succeeded' ELSE 'rejected' END AS outcome, CASE WHEN p_size % 5 = 0 THEN 'ValueError: size ' || p_size ELSE 'route' END AS message FROM part WHERE p_partkey % 2 = 0")
def benchmark_routes_run(spark, d):
    def route(row):
        if row["size"] % 5 == 0:
            raise ValueError(f"size {row['size']}")
        return ("succeeded" if row["size"] > 25 else "rejected", "route")

    rows = _t(spark, d, "part").selectExpr("p_partkey AS product_id", "p_size AS size", "CASE WHEN p_partkey % 2 = 0 THEN 'source' ELSE 'reference' END AS role")
    return governance.run_routes(rows, route).select("product_id", "outcome", "message")


# --- stages ------------------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT p_partkey AS id, sha256('{"algorithm":' || CASE WHEN p_size % 2 = 0 THEN 'null' ELSE '"ncc"' END || ',"algorithm_version":"1","input_digests":{"a":"' || p_size || '"},"parameter_subset":{"k":' || p_size % 4 || ',"z":[1,2]},"stage_name":"' || p_brand || '","stage_version":"2"}') AS fingerprint FROM part)
    SELECT id, fingerprint, id % 3 <> 0 AND id % 5 <> 0 AND id % 7 <> 0 AS reusable FROM p""")
def stage_reuse(spark, d):
    p = _t(spark, d, "part").selectExpr("p_partkey AS id", "cast(p_partkey AS string) AS n", "p_brand AS stage_name", "'2' AS stage_version", "CASE WHEN p_size % 2 = 1 THEN 'ncc' END AS algorithm", "'1' AS algorithm_version", """'{"a":"' || p_size || '"}' AS input_digests""", """'{"z":[1, 2],"k":' || p_size % 4 || '}' AS parameter_subset""")
    rows = governance.with_fingerprint(p).select("id", F.col("n").alias("stage_name"), "fingerprint")
    results = rows.where("id % 3 <> 0").select("stage_name", "fingerprint", F.when(F.col("id") % 5 == 0, "failed").otherwise("succeeded").alias("outcome"), F.lit(True).alias("published"))
    outputs = rows.select("stage_name", F.concat(F.lit("u"), "stage_name").alias("uri"), F.lit("aa").alias("sha256"))
    found = rows.select(F.concat(F.lit("u"), "stage_name").alias("uri"), F.when(F.col("id") % 7 == 0, "bb").otherwise("aa").alias("sha256"))
    return governance.reusable_stages(rows, results, outputs, found).select("id", "fingerprint", "reusable")


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'x' ELSE '' END AS unknown, CASE WHEN p_size % 3 = 0 THEN 'a' ELSE '' END AS missing, CASE WHEN p_size % 4 = 0 THEN '[redacted]' WHEN p_size % 4 = 1 THEN 'see [redacted] now' WHEN p_size % 4 = 2 THEN repeat('y', 20) || '... [' || 20 + p_size || ' chars]' WHEN p_size % 8 = 3 THEN repeat('z', 2048) || CASE WHEN p_size % 16 = 3 THEN '... [2049 chars]' ELSE '' END ELSE p_name END AS logged,
    CASE WHEN p_size > 10 THEN 11 ELSE p_size END AS items FROM part""")
def parameters_and_logs(spark, d):
    p = _t(spark, d, "part").selectExpr("p_partkey AS id", "p_size AS k", "p_name", "CASE WHEN p_size % 2 = 0 THEN array('x', 'b') ELSE array('b') END AS base")
    p = p.withColumn("supplied", F.when(F.col("k") % 3 == 0, F.col("base")).otherwise(F.concat("base", F.array(F.lit("a"))))).withColumn("declared", F.array(F.lit("a"), F.lit("b")))
    text = F.when(F.col("k") % 4 == 1, "see https://h/x?a=1&sig=abc now").when(F.col("k") % 4 == 2, F.repeat(F.lit("y"), 20 + F.col("k"))).when(F.col("k") % 8 == 3, F.repeat(F.lit("z"), F.when(F.col("k") % 16 == 3, 2049).otherwise(2048))).otherwise(F.col("p_name"))
    key = F.when(F.col("k") % 4 == 0, "Api-Key").otherwise("note")
    limit = F.when(F.col("k") % 4 == 2, governance.log_safe(key, text, 20)).otherwise(governance.log_safe(key, text))
    items = governance.log_safe_list(F.transform(F.sequence(F.lit(1), F.col("k")), lambda x: x.cast("string")), 10)
    return governance.parameter_problems(p).select("id", F.array_join("unknown", ",").alias("unknown"), F.array_join("missing", ",").alias("missing"), limit.alias("logged"), F.size(items).alias("items"))


# --- routes ------------------------------------------------------------------------------------------------------


@query("""WITH b AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, l_partkey % 90 - 45.0e0 AS lat, l_suppkey % 50 + 0.0e0 AS lon, l_quantity / 1000 AS off FROM lineitem), e AS (SELECT *, lat + off AS lat2 FROM b WHERE NOT (id % 5 = 0 AND n = 1)),
    d AS (SELECT b.id, 2 * 1737400 * asin(sqrt(sin(radians(e.lat2 - b.lat) / 2) ** 2)) AS m FROM b LEFT JOIN e ON e.id = b.id AND e.n = b.n)
    SELECT id, CASE WHEN count(m) = count(*) THEN round(avg(m), 3) END AS mean_m, CASE WHEN count(m) = count(*) THEN round(max(m), 3) END AS max_m, CASE WHEN count(m) < count(*) THEN 'unavailable' WHEN max(m) <= 1200 THEN 'agrees' ELSE 'disagrees' END AS status FROM d GROUP BY 1""")
def footprints_validated(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    b = _t(spark, d, "lineitem").withColumn("ordinal", F.row_number().over(w)).selectExpr("l_orderkey AS footprint_id", "ordinal", "l_partkey % 90 - 45D AS lat", "l_suppkey % 50 + 0D AS lon", "l_quantity / 1000 AS off")
    e = b.where("NOT (footprint_id % 5 = 0 AND ordinal = 1)").withColumn("lat", F.col("lat") + F.col("off"))
    rows = routes.footprint_agreement(b.drop("off"), e.drop("off"), 1200.0)
    return rows.select(F.col("footprint_id").alias("id"), _r(F.col("mean_m"), 3).alias("mean_m"), _r(F.col("max_m"), 3).alias("max_m"), "status")


@query("""WITH q AS (SELECT p_partkey AS id, (p_size % 10)::DOUBLE AS x, (p_partkey % 10)::DOUBLE AS y FROM part) SELECT id, round(greatest(0, least(4, x + 3) - greatest(0, x)) * greatest(0, least(5, y + 2) - greatest(0, y)) / 20, 6) AS share, CASE WHEN id % 2 = 0 THEN round(CASE WHEN x <= 0 THEN 1 WHEN x >= 4 THEN 0 ELSE (4 - x) * (4 - x) / 16 END, 6) ELSE 0 END AS corner FROM q""")
def outline_overlap(spark, d):
    q = _t(spark, d, "part").selectExpr("p_partkey AS id", "cast(p_size % 10 AS double) AS x", "cast(p_partkey % 10 AS double) AS y")
    at = lambda x, y: F.struct((x if not isinstance(x, float) else F.lit(x)).alias("x"), (y if not isinstance(y, float) else F.lit(y)).alias("y"))
    x, y = F.col("x"), F.col("y")
    box = F.array(at(0.0, 0.0), at(4.0, 0.0), at(4.0, 5.0), at(0.0, 5.0))
    other = F.array(at(x, y + 2), at(x + 3, y + 2), at(x + 3, y), at(x, y))  # the other way round
    corner, cut = F.array(at(0.0, 0.0), at(4.0, 0.0), at(0.0, 4.0)), F.array(at(x, -1.0), at(x + 20, -1.0), at(x + 20, 9.0), at(x, 9.0))
    bent = F.array(at(0.0, 0.0), at(4.0, 0.0), at(1.0, 1.0), at(0.0, 4.0))
    return q.select("id", _r(routes.overlap_share(box, other)).alias("share"), _r(F.when(F.col("id") % 2 == 0, routes.overlap_share(corner, cut)).otherwise(routes.overlap_share(bent, cut))).alias("corner"))


_ASSET = "SELECT p_size AS bundle_id, p_partkey AS ordinal, 'a' || p_partkey AS identifier, CASE p_partkey % 4 WHEN 0 THEN 'sldem2015' WHEN 1 THEN 'polar_dem' WHEN 2 THEN 'lola' ELSE 'image' END AS kind, CASE WHEN p_partkey % 3 = 0 THEN 'control' ELSE 'terrain' END AS role, p_partkey % 2 = 0 AS controlled, p_partkey % 90 - 90.0e0 AS lat_low, p_partkey % 70 + 10.0e0 AS lat_high, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 4 * 1.0e0 END AS horizontal_uncertainty_m FROM part"


def _assets(spark, d):
    return _t(spark, d, "part").selectExpr(*_ASSET.removeprefix("SELECT ").removesuffix(" FROM part").replace("e0", "D").split(", "))


@query(f"WITH a AS ({_ASSET}) SELECT bundle_id, bool_or(role = 'control' AND controlled) AS has_control, coalesce(bool_or(role = 'control' AND controlled AND lat_low <= -20 AND 30 <= lat_high), false) AS has_control_for_span, coalesce(bool_or(role = 'control' AND controlled AND lat_low <= -20 AND 30 <= lat_high AND coalesce(horizontal_uncertainty_m > 0, false)), false) AS has_qualified_control FROM a GROUP BY 1")
def geodetic_control(spark, d):
    return routes.control_of(_assets(spark, d), F.lit(-20.0), F.lit(30.0))


@query(f"""WITH a AS ({_ASSET}), s AS (SELECT o_orderkey AS site, o_custkey % 50 + 1 AS bundle_id, (o_orderkey * 7 % 1800) / 10.0e0 - 90 AS latitude FROM orders), b AS (SELECT s.*, identifier, kind, row_number() OVER (PARTITION BY site ORDER BY CASE WHEN kind = 'sldem2015' AND abs(latitude) <= 60 THEN 1 WHEN kind = 'polar_dem' THEN 2 ELSE 3 END, ordinal) AS n
        FROM s JOIN a ON a.bundle_id = s.bundle_id WHERE role = 'terrain' AND latitude BETWEEN lat_low AND lat_high AND (kind IN ('polar_dem', 'lola') OR (kind = 'sldem2015' AND abs(latitude) <= 60)))
    SELECT s.site, round(s.latitude, 3) AS latitude, b.identifier, b.kind, b.site IS NOT NULL AS available FROM s LEFT JOIN b ON b.site = s.site AND b.n = 1""")
def terrain_references(spark, d):
    sites = _t(spark, d, "orders").selectExpr("o_orderkey AS site", "o_custkey % 50 + 1 AS bundle_id", "(o_orderkey * 7 % 1800) / 10D - 90 AS latitude")
    return routes.terrain_references(sites, _assets(spark, d)).select("site", _r(F.col("latitude"), 3).alias("latitude"), "identifier", "kind", "available")


_ROUTE = """l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount AS overlap, l_quantity AS s_gsd_line_m, l_quantity / 2 + 1 AS s_gsd_sample_m, 5 + l_tax * 100 AS r_gsd_line_m, 6.0e0 AS r_gsd_sample_m, l_quantity AS s_gsd_uncertainty_m,
    CASE WHEN l_suppkey % 3 = 0 THEN 'synthetic' ELSE 'externally_validated' END AS s_validation, CASE WHEN l_partkey % 11 = 0 THEN 'invalid' ELSE 'externally_validated' END AS r_validation, CASE WHEN l_suppkey % 7 = 0 THEN 'self_consistent' ELSE 'externally_validated' END AS local_validation,
    l_partkey % 2 = 0 AS has_control, l_partkey % 4 = 0 AS has_qualified_control, CASE WHEN l_linenumber < 4 THEN l_linenumber * 40.0e0 - 41 END AS prior_uncertainty_px, l_suppkey % 5 = 0 AS limited_sensor,
    CASE WHEN l_linenumber > 5 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'externally_validated' ELSE 'synthetic' END END AS warp_validation, CASE WHEN l_partkey % 3 = 0 THEN 'survey' END AS warp_evidence, CASE WHEN l_partkey % 5 = 0 THEN ' ' ELSE 'fit' END AS warp_provenance, l_quantity / 4 AS warp_uncertainty_px"""


def _preflight_sql(external: bool, control: bool) -> str:
    policy = lambda on, case: f"CASE WHEN {str(on).lower()} THEN {case} END"
    unsure = "CASE WHEN NOT has_control THEN 'no_geodetic_control' WHEN NOT has_qualified_control THEN 'control_not_qualified' END"
    return f"""WITH q AS (SELECT {_ROUTE} FROM lineitem), u AS (SELECT *, CASE WHEN warp_validation IS NOT NULL THEN warp_uncertainty_px ELSE coalesce(prior_uncertainty_px, 3 * s_gsd_uncertainty_m / greatest(r_gsd_line_m, r_gsd_sample_m)) END AS unc, greatest(s_gsd_line_m, s_gsd_sample_m) / least(r_gsd_line_m, r_gsd_sample_m) AS scale,
    greatest(s_gsd_line_m, s_gsd_sample_m, r_gsd_line_m, r_gsd_sample_m) / least(s_gsd_line_m, s_gsd_sample_m, r_gsd_line_m, r_gsd_sample_m) AS ratio, s_validation = 'synthetic' OR r_validation = 'invalid' OR local_validation = 'self_consistent' AS open FROM q), v AS (SELECT *, greatest(2, unc * greatest(1, scale)) AS radius FROM u),
    w AS (SELECT *, concat_ws(';', CASE WHEN r_validation = 'invalid' THEN 'geometry_unavailable' END, {policy(external, "CASE WHEN open THEN 'geometry_not_validated' END")}, CASE WHEN overlap < 0.05 THEN 'overlap_too_small' END, {policy(control, unsure)},
    CASE WHEN warp_validation = 'synthetic' OR (warp_validation IS NOT NULL AND (warp_evidence IS NULL OR trim(warp_provenance) = '')) THEN 'warp_prior_not_validated' END, CASE WHEN unc < 0 THEN 'search_uncertainty_invalid' END, CASE WHEN ratio > 8 THEN 'gsd_ratio_too_large' END, CASE WHEN radius > 512 THEN 'search_radius_too_large' END) AS reasons,
    concat_ws(';', CASE WHEN limited_sensor THEN 'approximate pointing' END, {unsure}) AS limitations FROM v)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(ratio, 5) AS gsd_ratio, round(radius, 4) AS search_radius_px, reasons, limitations, CASE WHEN reasons <> '' THEN 'inadmissible' WHEN open THEN 'limited' ELSE 'admissible' END AS state FROM w"""


def _preflight(spark, d, **policy):
    q = _t(spark, d, "lineitem").selectExpr(*re.split(r",\s+", _ROUTE.replace("e0", "D")))
    q = q.withColumn("validations", F.array("s_validation", F.lit("externally_validated"), "r_validation", "local_validation", F.lit("externally_validated")))
    q = q.withColumn("sensor_limitations", F.when(F.col("limited_sensor"), F.array(F.lit("approximate pointing"))).otherwise(F.array().cast("array<string>")))
    rows = routes.preflight(q, **policy)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", _r(F.col("gsd_ratio"), 5).alias("gsd_ratio"), _r(F.col("search_radius_px"), 4).alias("search_radius_px"), F.array_join("reasons", ";").alias("reasons"), F.array_join("limitations", ";").alias("limitations"), "state")


@query(_preflight_sql(True, True))
def route_preflight(spark, d):
    return _preflight(spark, d)


@query(_preflight_sql(False, False))
def route_preflight_exploratory(spark, d):
    """Without the demands for validated geometry and control: routes whose geometry is open are limited, not inadmissible."""
    return _preflight(spark, d, require_external_geometry=False, require_geodetic_control=False)


# --- adjustment diagnostics and candidates -----------------------------------------------------------------------

_RES = "l_partkey AS job_id, l_quantity AS line, l_tax * 10 - 0.4 AS dy, l_discount * 10 - 0.5 AS dx, l_extendedprice / 30000 AS norm"


def _residuals(spark, d):
    return _t(spark, d, "lineitem").selectExpr(*_RES.replace("0.4", "0.4D").replace("0.5", "0.5D").split(", "))


@query(f"""WITH r AS (SELECT {_RES} FROM lineitem), e AS (SELECT *, sqrt(dy * dy + dx * dx) AS e FROM r), a AS (SELECT job_id, count(*) AS n, sqrt(avg(dy * dy)) AS ry, sqrt(avg(dx * dx)) AS rx, sqrt(avg(e * e)) AS r2, quantile_cont(e, 0.5) AS m, quantile_cont(e, 0.9) AS p, sum(CASE WHEN norm <= 1.345 THEN 0.5 * norm * norm ELSE 1.345 * (norm - 0.6725) END) AS loss,
        CASE WHEN count(*) > 1 AND var_pop(line) * count(*) > 1e-20 AND var_pop(dy) * count(*) > 1e-20 THEN corr(line, dy) END AS cy, var_samp(dy - dx) AS nv FROM e GROUP BY 1)
    SELECT job_id, n, round(ry, 6) AS rmse_y_px, round(rx, 6) AS rmse_x_px, round(r2, 6) AS rmse_2d_px, round(m, 6) AS median_px, round(p, 6) AS p90_px, round(loss, 5) AS loss, round(cy, 5) AS line_to_y, round(nv, 6) AS noise_variance FROM a""")
def adjustment_diagnostics(spark, d):
    r = _residuals(spark, d)
    loss = r.groupBy("job_id").agg(F.sum(routes.huber_loss(F.col("norm"))).alias("loss"))
    rows = routes.residual_metrics(r, ["job_id"]).join(loss, "job_id").join(routes.scan_line_correlation(r, ["job_id"], 1e-10), "job_id").join(routes.noise_variance(r, ["job_id"], "dy", "dx"), "job_id")
    digits = {"rmse_y_px": 6, "rmse_x_px": 6, "rmse_2d_px": 6, "median_px": 6, "p90_px": 6, "loss": 5, "line_to_y": 5, "noise_variance": 6}
    return rows.select("job_id", "n", *[_r(F.col(c), k).alias(c) for c, k in digits.items()])


@query(f"""WITH r AS (SELECT {_RES} FROM lineitem), s AS (SELECT job_id, count(*) AS n_trials, (var_samp(dy) + var_samp(dx)) / 0.5 AS k FROM r GROUP BY 1), d AS (SELECT r.job_id, n_trials, k, (dy * dy * 0.2e0 - 2 * dy * dx * 0.1e0 + dx * dx * 0.3e0) / (0.3e0 * 0.2e0 - 0.1e0 * 0.1e0) AS q FROM r JOIN s ON s.job_id = r.job_id)
    SELECT job_id, n_trials, round(max(k), 6) AS scale, round(avg((q <= 1)::INT), 6) AS coverage, round(avg((q <= k)::INT), 6) AS calibrated_coverage FROM d WHERE k > 0 GROUP BY 1, 2""")
def covariance_calibration(spark, d):
    r = _residuals(spark, d).withColumns({"yy": F.lit(0.3), "yx": F.lit(0.1), "xx": F.lit(0.2)})
    rows = routes.covariance_scale(r, ["job_id"]).where("scale > 0")
    return rows.select("job_id", "n_trials", *[_r(F.col(c)).alias(c) for c in ("scale", "coverage", "calibrated_coverage")])


@query("""WITH f AS (SELECT l_partkey AS job_id, l_orderkey AS line, l_linenumber AS sample, l_suppkey, l_quantity AS score FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, line, sample, l_suppkey) AS n FROM f) SELECT job_id, n AS rank, score FROM k WHERE n <= 5""")
def best_candidates(spark, d):
    f = _t(spark, d, "lineitem").selectExpr("l_partkey AS job_id", "l_orderkey AS line", "l_linenumber AS sample", "l_quantity AS score")
    return routes.best_candidates(f, ["job_id"], 5).select("job_id", F.col("rank").cast("long").alias("rank"), "score")


_FLOW = "l_suppkey % 20 AS image_id, l_orderkey % 300 AS line, l_partkey % 64 AS sample, l_tax * 100 - 4.3 AS dy, l_discount * 60 - 3.2 AS dx"


@query(f"""WITH f AS (SELECT DISTINCT {_FLOW} FROM lineitem), v AS (SELECT a AS image_id, b AS line, c AS sample FROM range(20) x(a), range(300) y(b), range(64) z(c) WHERE (b * 3 + c * 5) % 4 > 0)
    SELECT f.image_id, f.line, f.sample, round(f.line + dy, 4) AS ref_line, round(f.sample + dx, 4) AS ref_sample FROM f JOIN v ON v.image_id = f.image_id AND v.line = round(f.line + dy) AND v.sample = round(f.sample + dx) WHERE f.line % 3 = 0 AND f.sample % 3 = 0 AND (f.line + f.sample) % 7 > 0 AND (dy - 1) ** 2 + (dx + 1) ** 2 <= 9 AND f.line + dy > -0.5 AND f.sample + dx > -0.5""")
def flow_candidates(spark, d):
    f = _t(spark, d, "lineitem").selectExpr(*_FLOW.replace("4.3", "4.3D").replace("3.2", "3.2D").split(", ")).distinct()
    f = f.selectExpr("*", "(line + sample) % 7 > 0 AS valid", "1D AS prior_dy", "-1D AS prior_dx", "0D AS log_variance")
    n = F.col("id")
    v = spark.range(20 * 300 * 64).select((n % 20).alias("image_id"), (F.floor(n / 20) % 300).alias("line"), F.floor(n / 6000).alias("sample")).withColumn("valid", (F.col("line") * 3 + F.col("sample") * 5) % 4 > 0)
    rows = routes.flow_candidates(f, v, 3, 3.0)
    return rows.select("image_id", "line", "sample", _r(F.col("ref_line"), 4).alias("ref_line"), _r(F.col("ref_sample"), 4).alias("ref_sample"))


@query("SELECT l_partkey AS job_id, round(var_samp(l_quantity - l_discount * 100), 6) AS noise_variance FROM lineitem GROUP BY 1")
def residual_noise(spark, d):
    rows = _t(spark, d, "lineitem").selectExpr("l_partkey AS job_id", "l_quantity AS template", "l_discount * 100 AS warped")
    return routes.noise_variance(rows, ["job_id"], "template", "warped").select("job_id", _r(F.col("noise_variance")).alias("noise_variance"))
