"""Ordered-trace queries over events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import sequences as S
from strandline.plans.registry import query
from strandline.session import table

ORDER = ["ts", "event_id"]


@query(
    "segment_trace",
    """WITH n AS (SELECT *, coalesce(sum(CASE WHEN event_type IN ('error', 'purchase') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS segment_index FROM events)
    SELECT user_id, segment_index, arg_min(event_id, (ts, event_id)) AS first_event, arg_max(event_id, (ts, event_id)) AS last_event, count(*)::BIGINT AS n_events,
    bool_or(event_type IN ('error', 'purchase')) AS closed FROM n GROUP BY user_id, segment_index""",
)
def segment_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.segment_trace(table(spark, sf_dir, "events"), "user_id", ORDER, F.col("event_type").isin("error", "purchase"), "event_id")


@query(
    "precondition_tail",
    """WITH n AS (SELECT *, event_type IN ('error', 'purchase') AS b, list(event_id) FILTER (event_type NOT IN ('error', 'purchase')) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS f FROM events)
    SELECT user_id, event_id AS boundary_event, coalesce(f, []) AS facts FROM n WHERE b""",
)
def precondition_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.precondition_tail(table(spark, sf_dir, "events"), "user_id", ORDER, F.col("event_type").isin("error", "purchase"), "event_id")


@query(
    "asof_attribution",
    """SELECT user_id, event_id AS event, marker_event FROM (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS)
    OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS marker_event FROM events) WHERE event_type <> 'signup'""",
)
def asof_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.asof_attribution(table(spark, sf_dir, "events"), "user_id", ORDER, F.col("event_type") == "signup", "event_id")


@query(
    "caller_map",
    """WITH s AS (SELECT conv_id, turn, role, sum(CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN -1 ELSE 0 END) OVER w AS s FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
    SELECT conv_id, turn, role, (s - least(0, min(s) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)))::BIGINT AS depth FROM s""",
)
def caller_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return S.call_depth(turns, "conv_id", ["turn"], F.col("role") == "user", F.col("role") == "assistant")


@query("caller_edges")
def caller_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caller of every event type, where views and clicks push a frame and errors pop one; held against a stack machine in the tests."""
    seen = table(spark, sf_dir, "events").select("user_id", *ORDER, "event_type")
    return S.caller_of(seen, "user_id", ORDER, F.col("event_type").isin("view", "click", "signup"), F.col("event_type") == "error", "event_type")


@query(
    "merge_windows",
    """WITH s AS (SELECT user_id, event_id - 3 AS low, event_id + 5 AS high FROM events),
    r AS (SELECT *, max(high) OVER (PARTITION BY user_id ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR low > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS island FROM r)
    SELECT user_id, min(low) AS low, max(high) AS high, count(*)::BIGINT AS n_points FROM i GROUP BY user_id, island""",
)
def merge_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.merge_windows(table(spark, sf_dir, "events"), "user_id", "event_id", 3, 5)


@query(
    "reaching_defs",
    """SELECT user_id, event_id AS use_event, def_event FROM (SELECT *, last_value(CASE WHEN event_type IN ('signup', 'view') THEN event_id END IGNORE NULLS)
    OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS def_event FROM events) WHERE event_type = 'purchase'""",
)
def reaching_defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.reaching_definitions_straight(table(spark, sf_dir, "events"), "user_id", ORDER, F.col("event_type").isin("signup", "view"), F.col("event_type") == "purchase", "event_id")


@query(
    "state_accumulation",
    """SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, count(*)::BIGINT AS n_writes FROM events GROUP BY user_id, event_type""",
)
def state_accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.accumulate_state(table(spark, sf_dir, "events"), "user_id", ORDER, "event_type", "value")
