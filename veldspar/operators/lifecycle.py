"""Run lifecycle as folds over events: transitions, latest state, commands, reviews, idempotency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The allowed transitions of a run's state.
TRANSITIONS = {
    "created": ("queued", "cancelled"),
    "queued": ("running", "cancelled"),
    "running": ("cancelling", "succeeded", "failed"),
    "cancelling": ("cancelled", "failed"),
    "cancelled": (),
    "succeeded": (),
    "failed": (),
}
STATES = tuple(TRANSITIONS)


def allowed(previous: Column, new: Column) -> Column:
    ok = F.lit(False)
    for state, targets in TRANSITIONS.items():
        if targets:
            ok = ok | ((previous == state) & new.isin(*targets))
    return F.coalesce(ok, F.lit(False))


def transition_violations(events: DataFrame) -> DataFrame:
    """events: run_id, sequence, state. Rows whose state may not follow the run's state before."""
    w = Window.partitionBy("run_id").orderBy("sequence")
    rows = events.withColumn("previous", F.lag("state").over(w)).where("previous is not null")
    return rows.where(~allowed(F.col("previous"), F.col("state"))).select("run_id", "sequence", "previous", "state")


def latest_state(events: DataFrame) -> DataFrame:
    return events.groupBy("run_id").agg(F.max_by("state", "sequence").alias("state"), F.max("sequence").alias("event_sequence"), F.count(F.lit(1)).alias("events"))


def cancellation_target(state: Column) -> Column:
    return F.when(state.isin("created", "queued"), "cancelled").when(state == "running", "cancelling")


def disposition_after_review(verdict: Column, decision: Column) -> Column:
    return F.when(verdict == "accept", "accepted").when(verdict == "reject", "rejected").when((verdict == "review") & decision.isNotNull(), decision).otherwise("pending")


def effective_disposition(scenes: DataFrame, reviews: DataFrame) -> DataFrame:
    """scenes: scene, verdict. reviews: scene, input_verdict, decision, at, ord. The latest review of a review verdict counts."""
    last = reviews.where(F.col("input_verdict") == "review").groupBy("scene").agg(F.max_by("decision", F.struct("at", "ord")).alias("decision"))
    return scenes.join(last, "scene", "left").withColumn("disposition", disposition_after_review(F.col("verdict"), F.col("decision")))


def replay(commands: DataFrame) -> DataFrame:
    """commands: key, digest, at, ord. First command of a key wins; the same digest replays, another conflicts."""
    w = Window.partitionBy("key").orderBy("at", "ord")
    rows = commands.withColumn("first_digest", F.first("digest").over(w)).withColumn("n", F.row_number().over(w))
    return rows.withColumn("outcome", F.when(F.col("n") == 1, "created").when(F.col("digest") == F.col("first_digest"), "replayed").otherwise("conflict")).drop("n", "first_digest")


#: Fixed value: how long a stored response answers repeated commands.
RETENTION = "INTERVAL 24 HOURS"
#: Keys of an event's payload that only the store may set.
RESERVED = ("actor_subject_id", "event_type", "execution_state", "from_execution_state", "run_id", "sequence", "state_version", "to_execution_state")


def replay_within(commands: DataFrame, retention: str = RETENTION) -> DataFrame:
    """As replay, but a key that comes again after the retention of its first command is expired: a conflict, whatever its digest."""
    w = Window.partitionBy("key").orderBy("at", "ord")
    rows = commands.withColumn("_digest", F.first("digest").over(w)).withColumn("_at", F.first("at").over(w)).withColumn("_n", F.row_number().over(w))
    late = F.col("at") > F.col("_at") + F.expr(retention)
    outcome = F.when(F.col("_n") == 1, "created").when(late, "expired").when(F.col("digest") == F.col("_digest"), "replayed").otherwise("conflict")
    return rows.withColumn("outcome", outcome).drop("_digest", "_at", "_n")


def apply_transitions(requests: DataFrame) -> DataFrame:
    """requests: run_id, ord, expected_state, expected_version, new_state (a run starts as created, version 1). Each is compared with the run's state as left by those accepted
    before it. Adds accepted, state, state_version and event_sequence after it. Reserved keys in `payload` (map), if there, refuse a request.

    A fold over each run's own requests in order: an aggregate of at most a run's history."""
    payload = F.exists(F.map_keys("payload"), lambda k: k.isin(*RESERVED)) if "payload" in requests.columns else F.lit(False)
    rows = requests.withColumn("_refused", F.coalesce(payload, F.lit(False)))
    step = F.struct("ord", "expected_state", F.col("expected_version").cast("long").alias("expected_version"), "new_state", "_refused")
    runs = rows.groupBy("run_id").agg(F.sort_array(F.collect_list(step)).alias("steps"))
    state = "struct<state:string,version:bigint,log:array<struct<ord:bigint,accepted:boolean,state:string,state_version:bigint>>>"
    start = F.struct(F.lit("created").alias("state"), F.lit(1).cast("long").alias("version"), F.array().alias("log")).cast(state)

    def fold(acc: Column, x: Column) -> Column:
        ok = F.coalesce(~x["_refused"] & (x["expected_state"] == acc["state"]) & (x["expected_version"] == acc["version"]) & allowed(acc["state"], x["new_state"]), F.lit(False))
        now = F.when(ok, x["new_state"]).otherwise(acc["state"])
        version = acc["version"] + ok.cast("long")
        entry = F.struct(x["ord"].cast("long").alias("ord"), ok.alias("accepted"), now.alias("state"), version.alias("state_version"))
        return F.struct(now.alias("state"), version.alias("version"), F.concat(acc["log"], F.array(entry)).alias("log")).cast(state)

    logs = runs.select("run_id", F.explode(F.aggregate("steps", start, fold)["log"]).alias("l")).select("run_id", "l.*")
    return logs.withColumn("event_sequence", F.col("state_version"))


def new_run_events(runs: DataFrame) -> DataFrame:
    """The first event of each run."""
    return runs.select(F.col("id").alias("run_id"), F.lit(1).cast("long").alias("sequence"), F.lit("run.created").alias("event_type"), F.lit("created").alias("state"), F.col("created_at").alias("recorded_at"))


def review_outcomes(reviews: DataFrame, runs: DataFrame) -> DataFrame:
    """reviews: run_id, at, ord, actor_role, decision. runs: id, state, verdict. Adds refusal (null if the review counts: reviewers, admins and callers without a role
    review succeeded runs with a verdict) and the run's disposition after it; the verdict stays as it is."""
    r = runs.select(F.col("id").alias("run_id"), F.col("state").alias("_state"), F.col("verdict").alias("_verdict"))
    rows = reviews.join(r, "run_id", "left")
    refusal = (
        F.when(~F.coalesce(F.col("actor_role").isin("reviewer", "admin"), F.lit(True)), "role_not_allowed").when(F.col("_state").isNull(), "run_not_found")
        .when((F.col("_state") != "succeeded") | F.col("_verdict").isNull(), "run_not_reviewable").when(~F.coalesce(F.col("decision").isin("accepted", "rejected"), F.lit(False)), "decision_unknown")
    )
    return rows.withColumn("refusal", refusal).withColumn("disposition", F.when(refusal.isNull(), disposition_after_review(F.col("_verdict"), F.col("decision")))).drop("_state", "_verdict")


def insert_if_absent(rows: DataFrame, stored: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows to append: of those with one key the first in order, and only where no stored row has the key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").join(stored.select(*keys).distinct(), keys, "left_anti")


def missing_parents(rows: DataFrame, references: dict[str, DataFrame]) -> DataFrame:
    """Adds missing: the reference columns whose value no parent has (references: column -> parents with a column id); a null reference is missing too."""
    gaps = []
    for column, parents in references.items():
        ids = parents.select(F.col("id").alias(f"_{column}"), F.lit(True).alias(f"_has_{column}")).distinct()
        rows = rows.join(ids, F.col(column) == F.col(f"_{column}"), "left").drop(f"_{column}")
        gaps.append(F.when(F.col(f"_has_{column}").isNull(), F.lit(column)))
    return rows.withColumn("missing", F.array_join(F.array_compact(F.array(*gaps)), ",")).drop(*[f"_has_{c}" for c in references])
