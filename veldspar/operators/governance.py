"""Benchmark governance and integrity as constraint queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.functions.hashing import digest_files, digest_json


#: The splits whose scenes must stay apart, and those that parameters may be fitted on.
PROTECTED = ("development", "validation", "held_out_test")
FIT_SPLITS = ("development", "validation")


def split_leakage(products: DataFrame, protected: tuple[str, ...] = PROTECTED) -> DataFrame:
    """products: product_id, ordinal, terrain_group, split_role. Terrain groups in two or more protected splits: splits, first_seen (the least ordinal of any of
    the group's products, which orders them) and how many protected products they hold; leaking_products names those."""
    rows = products.where(F.col("terrain_group").isNotNull())
    role = F.when(F.col("split_role").isin(*protected), F.col("split_role"))
    agg = rows.groupBy("terrain_group").agg(F.sort_array(F.collect_set(role)).alias("splits"), F.min("ordinal").alias("first_seen"), F.count(role).alias("products"))
    return agg.where(F.size("splits") >= 2).withColumn("splits", F.array_join("splits", ","))


def leaking_products(products: DataFrame, protected: tuple[str, ...] = PROTECTED) -> DataFrame:
    """terrain_group, product_id of the protected products of leaking groups, once each."""
    groups = split_leakage(products, protected).select("terrain_group")
    return products.where(F.col("split_role").isin(*protected)).join(groups, "terrain_group", "left_semi").select("terrain_group", "product_id").distinct()


def split_violations(products: DataFrame, protected: tuple[str, ...] = PROTECTED) -> DataFrame:
    """rule, subject: repeated product ids, protected sources without a terrain group, terrain groups that span protected splits."""
    repeated = repeated_keys(products, ["product_id"]).select(F.lit("repeated_product_id").alias("rule"), F.col("product_id").cast("string").alias("subject"))
    alone = products.where((F.col("role") == "source") & F.col("split_role").isin(*protected) & (F.coalesce(F.col("terrain_group").cast("string"), F.lit("")) == ""))
    alone = alone.select(F.lit("ungrouped_source").alias("rule"), F.col("product_id").cast("string").alias("subject"))
    span = split_leakage(products, protected).select(F.lit("group_spans_splits").alias("rule"), F.col("terrain_group").cast("string").alias("subject"))
    return repeated.unionByName(alone).unionByName(span)


def manifest_integrity(manifest: DataFrame, found: DataFrame, checksum_first: bool = False) -> DataFrame:
    """manifest: path, sha256, size. found: path, sha256, size. Acquisition tests size first, bundles test the checksum first; unlisted files are unknown, and
    listed paths that are absolute or climb out of the folder are unsafe, whatever lies there."""
    m = manifest.select("path", F.col("sha256").alias("m_sha"), F.col("size").alias("m_size"))
    f = found.select("path", F.col("sha256").alias("f_sha"), F.col("size").alias("f_size"))
    size = (F.col("m_size") != F.col("f_size"), "size_mismatch")
    check = (F.col("m_sha") != F.col("f_sha"), "checksum_mismatch")
    unsafe = F.col("m_sha").isNotNull() & F.col("path").cast("string").rlike(r"(^/)|(^|/)\.\.(/|$)")
    status = F.when(unsafe, "unsafe_path").when(F.col("f_sha").isNull(), "missing").when(F.col("m_sha").isNull(), "unknown")
    for cond, name in (check, size) if checksum_first else (size, check):
        status = status.when(cond, name)
    return m.join(f, "path", "full").select("path", status.otherwise("ok").alias("status"))


def dangling(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    return rows.join(parents, rows[key] == parents[parent_key], "left_anti")


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def kernel_inventory(entries: DataFrame, files: DataFrame, start: Column, stop: Column) -> DataFrame:
    """entries: name, sha256, start_utc, stop_utc, priority, status. files: name, sha256. Adds the code of the first rule that an entry
    breaks (null if sound): name, repeated name (all but the first by priority), digest, priority, status, missing or differing bytes, coverage."""
    first = F.row_number().over(Window.partitionBy("name").orderBy(F.desc_nulls_last("priority"), "sha256", "start_utc", "stop_utc", "status"))
    present = files.select(F.col("name").alias("__name"), F.col("sha256").alias("__sha"))
    rows = entries.withColumn("__nth", first).join(present, F.col("name") == F.col("__name"), "left")
    bad = lambda ok: ~F.coalesce(ok, F.lit(False))
    rules = [
        (bad((F.col("name") != "") & ~F.col("name").rlike(r"(^/)|(^|/)\.\.(/|$)")), "input.hostile_label"),
        (F.col("__nth") > 1, "input.label_unparseable"),
        (bad(F.col("sha256").rlike("^[0-9a-f]{64}$")) | F.col("priority").isNull() | bad(F.col("status").isin("predicted", "reconstructed")), "input.label_unparseable"),
        (F.col("__name").isNull(), "input.missing_file"),
        (F.col("sha256") != F.col("__sha"), "input.checksum_mismatch"),
        (bad((F.col("start_utc") <= F.col("stop_utc")) & (F.col("start_utc") <= start) & (F.col("stop_utc") >= stop)), "geometry.kernel_coverage_gap"),
    ]
    code = F.lit(None).cast("string")
    for broken, name in reversed(rules):
        code = F.when(broken, F.lit(name)).otherwise(code)
    return rows.withColumn("code", code).drop("__nth", "__name", "__sha")


# --- benchmark reports -------------------------------------------------------------------------------------------


def run_counts(scenes: DataFrame, checkpoints: DataFrame, key: str = "report_id") -> DataFrame:
    """scenes: report_id, product_id, split_role, outcome. checkpoints: report_id, checkpoint_id, scene_product_id, status. The summary that a report must state."""
    n = lambda *names: F.count_if(F.col("outcome").isin(*names))
    ran = scenes.groupBy(key).agg(F.count(F.lit(1)).alias("total_scenes"), n("succeeded", "succeeded_with_warnings").alias("succeeded"), n("rejected").alias("rejected"), n("failed").alias("failed"), n("cancelled").alias("cancelled"))
    held = checkpoints.groupBy(key).agg(F.count(F.lit(1)).alias("checkpoints"), *[F.count_if(F.col("status") == s).alias(f"checkpoints_{s}") for s in ("accepted", "excluded", "unresolved")])
    out = ran.join(held, key, "left")
    return out.select(*ran.columns, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in held.columns if c != key])


def _rule(rows: DataFrame, name: str, subject, key: str) -> DataFrame:
    return rows.select(key, F.lit(name).alias("rule"), (F.col(subject) if isinstance(subject, str) else subject).cast("string").alias("subject")).distinct()


def report_violations(scenes: DataFrame, checkpoints: DataFrame, tuning: DataFrame, stated: DataFrame, key: str = "report_id") -> DataFrame:
    """report_id, rule, subject of every broken rule: repeated scenes or checkpoints, held-out scenes used for tuning (tuning: report_id, product_id), checkpoints of scenes that
    aren't held out, held-out scenes without exactly one checkpoint, and stated summaries (columns of run_counts) that differ from what is counted."""
    held = scenes.where("split_role = 'held_out_test'").select(key, "product_id").distinct()
    of_scene = checkpoints.select(key, F.col("scene_product_id").alias("product_id"), "checkpoint_id")
    per_scene = held.join(of_scene.groupBy(key, "product_id").agg(F.count(F.lit(1)).alias("n")), [key, "product_id"], "left")
    counted = run_counts(scenes, checkpoints, key)
    same = F.lit(True)
    both = stated.select(key, *[F.col(c).alias(f"_{c}") for c in counted.columns if c != key]).join(counted, key, "left")
    for c in counted.columns:
        if c != key:
            same = same & F.coalesce(F.col(c) == F.col(f"_{c}"), F.lit(False))
    parts = [
        _rule(repeated_keys(scenes, [key, "product_id"]), "repeated_scene", "product_id", key), _rule(repeated_keys(checkpoints, [key, "checkpoint_id"]), "repeated_checkpoint", "checkpoint_id", key),
        _rule(held.join(tuning, [key, "product_id"], "left_semi"), "held_out_scene_tuned_on", "product_id", key), _rule(of_scene.join(held, [key, "product_id"], "left_anti"), "checkpoint_not_held_out", "checkpoint_id", key),
        _rule(per_scene.where("n IS NULL OR n <> 1"), "held_out_scene_needs_one_checkpoint", "product_id", key), _rule(both.where(~same), "summary_differs", F.lit("summary"), key),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: The status that a decision gives a checkpoint.
STATUS_OF = {"accept": "accepted", "exclude": "excluded", "unresolved": "unresolved"}


def checkpoint_rules(records: DataFrame) -> DataFrame:
    """records: reviewers (array of structs reviewer_id, decision), tuning_actor_ids (array), scene_tuned_on, disagreement_present, resolver_id, resolution (a decision; both
    null without one), status, report_split_role, in_report and report_agrees. Adds violation, the first broken rule, null if sound."""
    ids = F.transform("reviewers", lambda r: r["reviewer_id"])
    decisions = F.array_distinct(F.transform("reviewers", lambda r: r["decision"]))
    differ, resolved = F.size(decisions) > 1, F.col("resolution").isNotNull()
    due = F.try_element_at(F.create_map(*[F.lit(x) for kv in STATUS_OF.items() for x in kv]), F.when(differ, F.col("resolution")).otherwise(F.get(decisions, 0)))
    why = (
        F.when(F.size(F.array_distinct(ids)) != 2, "reviewers_not_two_people").when(F.arrays_overlap(ids, "tuning_actor_ids"), "reviewer_tuned_the_route").when(F.col("scene_tuned_on"), "scene_used_for_tuning")
        .when(F.col("disagreement_present") != differ, "disagreement_misstated").when(differ & ~resolved, "resolution_missing")
        .when(differ & (F.array_contains(ids, F.col("resolver_id")) | F.array_contains("tuning_actor_ids", F.col("resolver_id"))), "resolver_not_independent").when(~differ & resolved, "resolution_without_disagreement")
        .when(~F.coalesce(F.col("status") == due, F.lit(False)), "status_differs_from_decision").when(~F.coalesce(F.col("report_split_role") == "held_out_test", F.lit(False)), "scene_not_held_out")
        .when(~F.col("in_report"), "absent_from_report").when(~F.col("report_agrees"), "report_disagrees")
    )
    return records.withColumn("violation", why)


def fit_violations(inputs: DataFrame, products: DataFrame, splits: tuple[str, ...] = FIT_SPLITS) -> DataFrame:
    """inputs: fit_id, product_id, split_role. products: product_id, split_role of the manifest. fit_id, product_id, rule of inputs that are repeated, stated with another role than
    the manifest's, or from a split that parameters may not be fitted on."""
    one = inputs.groupBy("fit_id", "product_id").agg(F.count(F.lit(1)).alias("_n"), F.max("split_role").alias("split_role"))  # a row for each input; the role counts only of one that isn't repeated
    own = products.groupBy("product_id").agg(F.collect_set(F.struct(F.col("split_role").alias("role"))).alias("_roles"))  # those of a product that is listed twice are all held against it
    unlisted = F.array(F.struct(F.lit(None).cast("string").alias("role")))

    def judged(r: Column) -> Column:
        return F.when(F.col("_n") > 1, "repeated_input").when(~F.coalesce(r["role"] == F.col("split_role"), F.lit(False)), "role_differs_from_manifest").when(~r["role"].isin(*splits), "split_not_for_fitting")

    rules = F.array_compact(F.array_distinct(F.transform(F.coalesce("_roles", unlisted), judged)))
    return one.join(own, "product_id", "left").select("fit_id", "product_id", F.explode(rules).alias("rule"))


def claim_violations(claims: DataFrame, reports: DataFrame, checkpoints: DataFrame, metrics: DataFrame, manifests: DataFrame) -> DataFrame:
    """claims: claim_id, report_id, checkpoint_id, scene_product_id, metric_key, value, unit, ref_value, ref_unit. reports: report_id, manifest_id, has_fit. checkpoints: checkpoint_id, report_id,
    scene_product_id, status. metrics: report_id, scene_product_id, metric_key, value, unit. manifests: manifest_id. Every claim with its first broken rule, null if it resolves."""
    n = F.count(F.lit(1)).over(Window.partitionBy("claim_id"))
    r = reports.select("report_id", F.col("manifest_id").alias("_manifest"), F.col("has_fit").alias("_fit"))
    c = checkpoints.select("checkpoint_id", F.col("report_id").alias("_c_report"), F.col("scene_product_id").alias("_c_scene"), F.col("status").alias("_c_status"))
    m = metrics.select("report_id", "scene_product_id", "metric_key", F.col("value").alias("_value"), F.col("unit").alias("_unit"), F.lit(True).alias("_has"))
    f = manifests.select(F.col("manifest_id").alias("_manifest"), F.lit(True).alias("_listed"))
    scenes = metrics.select("report_id", "scene_product_id", F.lit(True).alias("_scene")).distinct()
    rows = claims.withColumn("_n", n).join(r, "report_id", "left").join(c, "checkpoint_id", "left").join(scenes, ["report_id", "scene_product_id"], "left").join(m, ["report_id", "scene_product_id", "metric_key"], "left").join(f, "_manifest", "left")
    differs = lambda a, b: ~F.coalesce(F.col(a) == F.col(b), F.lit(False))
    rule = (
        F.when(F.col("_n") > 1, "repeated_claim").when(F.col("_fit").isNull(), "report_missing").when(F.col("_c_report").isNull(), "checkpoint_missing").when(differs("_c_report", "report_id"), "checkpoint_of_another_report")
        .when(F.col("_c_status") != "accepted", "checkpoint_not_accepted").when(differs("scene_product_id", "_c_scene"), "scene_not_the_checkpoints").when(differs("value", "ref_value") | differs("unit", "ref_unit"), "claim_differs_from_reference")
        .when(F.col("_scene").isNull(), "scene_not_in_report").when(F.col("_has").isNull(), "metric_missing").when(differs("_value", "ref_value") | differs("_unit", "ref_unit"), "metric_differs")
        .when(~F.col("_fit"), "fit_provenance_missing").when(F.col("_listed").isNull(), "manifest_missing")
    )
    return rows.withColumn("violation", rule).select("claim_id", "report_id", "violation")


def run_routes(products: DataFrame, route, schema: str = "outcome string, message string") -> DataFrame:
    """Every source product through a route (a function of a row as dict, giving (outcome, message)); one that raises fails that product alone."""
    import pyarrow as pa

    names = [f.split()[0] for f in schema.split(", ")]
    rows = products.where("role = 'source'")

    def run(batches):
        for b in batches:
            out = []
            for row in b.to_pylist():
                try:
                    out.append(tuple(route(row)))
                except Exception as error:  # the contract: no product stops the run
                    out.append(("failed", f"{type(error).__name__}: {error}"))
            yield pa.record_batch([*b.columns, *[pa.array([o[i] for o in out], pa.string()) for i in range(len(names))]], [*b.schema.names, *names])

    from pyspark.sql import types as T

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *[T.StructField(n, T.StringType()) for n in names]]))


# --- stages ------------------------------------------------------------------------------------------------------


def with_fingerprint(stages: DataFrame) -> DataFrame:
    """stages: stage_name, stage_version, algorithm, algorithm_version, input_digests and parameter_subset (JSON objects as text). Adds fingerprint: the digest of all of them and of nothing else."""
    quoted = lambda c: F.when(F.col(c).isNull(), "null").otherwise(F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)"))
    members = [F.concat(F.lit(f'"{c}":'), quoted(c)) for c in ("stage_name", "stage_version", "algorithm", "algorithm_version")] + [F.concat(F.lit(f'"{c}":'), F.coalesce(c, F.lit("{}"))) for c in ("input_digests", "parameter_subset")]
    return stages.withColumn("fingerprint", digest_json(F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))))


def reusable_stages(planned: DataFrame, results: DataFrame, outputs: DataFrame, found: DataFrame) -> DataFrame:
    """planned: stage_name, fingerprint. results: stage_name, fingerprint, outcome, published. outputs: stage_name, uri, sha256. found: uri, sha256 of the bytes that are there now.
    Adds reusable: the stage has succeeded with this fingerprint, was published, and every output's bytes are still those recorded."""
    now = found.select("uri", F.col("sha256").alias("_now"))
    intact = outputs.join(now, "uri", "left").groupBy("stage_name").agg(F.bool_and(F.coalesce(F.col("sha256") == F.col("_now"), F.lit(False))).alias("_intact"))
    done = results.where("outcome IN ('succeeded', 'succeeded_with_warnings') AND published").select("stage_name", "fingerprint", F.lit(True).alias("_done")).distinct()
    rows = planned.join(done, ["stage_name", "fingerprint"], "left").join(intact, "stage_name", "left")
    return rows.withColumn("reusable", F.coalesce("_done", F.lit(False)) & F.coalesce("_intact", F.lit(True))).drop("_done", "_intact")


def parameter_problems(runs: DataFrame) -> DataFrame:
    """runs: supplied and declared (arrays of names). Adds unknown and missing, sorted."""
    return runs.withColumn("unknown", F.sort_array(F.array_except("supplied", "declared"))).withColumn("missing", F.sort_array(F.array_except("declared", "supplied")))


#: Names whose values are never logged, links that carry a signature, and how much of a text or list is.
SENSITIVE = r"(?i)(token|secret|password|passwd|credential|api[_-]?key|authorization|signature|signed[_-]?url|cookie|session)"
SIGNED_URL = r"(?i)https?://\S*(?:[?&](?:X-Amz-Signature|Signature|AWSAccessKeyId|token|sig)=)\S*"
REDACTED, LONGEST_TEXT, LONGEST_LIST = "[redacted]", 2048, 64


def log_safe(key: Column, text: Column, longest: int = LONGEST_TEXT) -> Column:
    """A text as it may be logged under a key."""
    clean = F.regexp_replace(text, SIGNED_URL, REDACTED)
    short = F.when(F.length(clean) > longest, F.concat(F.substring(clean, 1, longest), F.lit("... ["), F.length(clean).cast("string"), F.lit(" chars]"))).otherwise(clean)
    return F.when(F.coalesce(key.rlike(SENSITIVE), F.lit(False)), REDACTED).otherwise(short)


def log_safe_list(items: Column, longest: int = LONGEST_LIST) -> Column:
    return F.when(F.size(items) > longest, F.concat(F.slice(items, 1, longest), F.array(F.concat(F.lit("... ["), F.size(items).cast("string"), F.lit(" items]"))))).otherwise(items)


def publish(rows: DataFrame, path: str) -> DataFrame:
    """Writes an artefact once (a second publication to the path raises) and gives uri, size_bytes and sha256 of its files."""
    rows.write.mode("errorifexists").parquet(path)
    return digest_files(rows.sparkSession, path).select(F.col("path").alias("uri"), "size_bytes", "sha256")
