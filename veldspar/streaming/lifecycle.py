"""Streaming forms of the lifecycle folds: the same folds as the batch operators, kept up as events arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_states(events: DataFrame, key: str = "run_id", order: str = "version", state: str = "state") -> DataFrame:
    """A row per key: state and version of its newest event, events seen. State grows with the keys; write it in update mode."""
    newest = F.max_by(F.col(state), F.col(order))
    return events.groupBy(key).agg(newest.alias(state), F.max(order).alias(order), F.count(F.lit(1)).alias("n_events"))


def first_submissions(requests: DataFrame, key: str = "idempotency_key", at: str = "created_at", horizon: str = "24 hours") -> DataFrame:
    """The first request of each key; replays within the horizon are dropped, and state older than it is let go."""
    return requests.withWatermark(at, horizon).dropDuplicatesWithinWatermark([key])
