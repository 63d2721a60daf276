"""Tenants: usage, quotas, plans, agents, isolation, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.lookup import lookup

# Limits and defaults per plan; an unknown plan has those of free.
PLAN_EVENTS_PER_SECOND = {"free": 25, "pro": 500, "enterprise": 5000}
PLAN_CALLS_PER_MINUTE = {"free": 300, "pro": 3000, "enterprise": 25000}
PLAN_PREDICTIONS_PER_DAY = {"free": 10000, "pro": 500000, "enterprise": 5000000}
STALE_SECONDS = 120


def _of_plan(table: dict[str, int], plan: str = "plan") -> Column:
    return lookup(table, plan, table["free"])


def plan_defaults(tenants: DataFrame) -> DataFrame:
    """Adds agent, rate, storage and retention limits of the tenant's plan.

    For these a plan that is neither free nor pro counts as enterprise, except for the rate.
    """

    def by_plan(free: int, pro: int, other: int) -> Column:
        return F.when(F.col("plan") == "free", free).when(F.col("plan") == "pro", pro).otherwise(other)

    return tenants.withColumns(
        {
            "agent_limit": by_plan(10, 250, 5000),
            "eps_limit": _of_plan(PLAN_EVENTS_PER_SECOND),
            "storage_limit_mb": by_plan(1024, 20480, 204800),
            "retention_days": by_plan(7, 30, 180),
        }
    )


def quota_check(usage: DataFrame, tenants: DataFrame) -> DataFrame:
    """Usage rows next to their plan's limits.

    ``within_limits`` looks at calls and predictions only.
    """
    plans = tenants.select("tenant_id", "plan")
    joined = usage.join(plans, "tenant_id", "left").withColumns(
        {
            "calls_limit": _of_plan(PLAN_CALLS_PER_MINUTE),
            "predictions_limit": _of_plan(PLAN_PREDICTIONS_PER_DAY),
            "eps_limit": _of_plan(PLAN_EVENTS_PER_SECOND),
        }
    )
    return joined.withColumn(
        "within_limits",
        (F.col("api_calls") <= F.col("calls_limit")) & (F.col("ml_predictions") <= F.col("predictions_limit")),
    )


def tenant_usage(events: DataFrame, period: str = "1 day", time: str = "ts") -> DataFrame:
    """Events, calls, predictions and storage per tenant and period.

    Needs ``is_call`` and ``is_prediction`` flags and ``bytes``.
    """
    return (
        events.groupBy("tenant_id", F.window(time, period).alias("_window"))
        .agg(
            F.count(F.lit(1)).alias("events_ingested"),
            F.count_if(F.col("is_call")).alias("api_calls"),
            F.count_if(F.col("is_prediction")).alias("ml_predictions"),
            (F.sum("bytes") / 1048576.0).alias("storage_mb"),
        )
        .select("tenant_id", F.unix_micros("_window.start").alias("period_at"), "events_ingested",
                "api_calls", "ml_predictions", "storage_mb")
    )


def latest_usage(usage: DataFrame) -> DataFrame:
    """The newest usage row per tenant."""
    whole = F.struct(*usage.columns)
    return usage.groupBy("tenant_id").agg(F.max_by(whole, "period_at").alias("_row")).select("_row.*")


def heartbeat_checks(heartbeats: DataFrame) -> DataFrame:
    """Adds ``verdict``: stale, replay or accepted.

    A heartbeat is stale when its signed time is over two minutes off its arrival; of the
    fresh ones with the same (agent, nonce, signed time) only the first is accepted.  Needs
    ``seq`` as arrival order.  The first is found by aggregation, not by sorting an agent's rows.
    """
    fresh = F.abs(F.col("received_at") - F.col("signed_at")) <= STALE_SECONDS * 1_000_000
    marks = ["agent_id", "nonce", "signed_at"]
    first = heartbeats.filter(fresh).groupBy(*marks).agg(F.min("seq").alias("_first"))
    joined = heartbeats.join(first, marks, "left")
    verdict = (
        F.when(~fresh, "stale").when(F.col("seq") == F.col("_first"), "accepted").otherwise("replay")
    )
    return joined.withColumn("verdict", verdict).drop("_first")


def agent_health(heartbeats: DataFrame) -> DataFrame:
    """Latest accepted heartbeat and status per agent."""
    accepted = heartbeat_checks(heartbeats).filter("verdict = 'accepted'")
    order = F.struct("received_at", "seq")
    return accepted.groupBy("agent_id").agg(
        F.max("received_at").alias("last_heartbeat_at"),
        F.when(F.lower(F.max_by("agent_health", order)) == "healthy", "active").otherwise("degraded").alias("status"),
        F.count(F.lit(1)).alias("heartbeats"),
    )


def tenant_quota(agents: DataFrame, tenants: DataFrame) -> DataFrame:
    """Agents per tenant against the plan's limit."""
    counted = agents.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("agents"))
    limits = plan_defaults(tenants).select("tenant_id", "plan", "agent_limit")
    joined = limits.join(counted, "tenant_id", "left").withColumn("agents", F.coalesce("agents", F.lit(0).cast("bigint")))
    return joined.withColumn("exceeded", F.col("agents") >= F.col("agent_limit"))


def tenant_view(df: DataFrame, tenant: str, at: str = "at", tie: str = "seq") -> DataFrame:
    """One tenant's rows, newest first."""
    return df.filter(F.col("tenant_id") == tenant).orderBy(F.desc(at), F.desc(tie))


def retention(df: DataFrame, tenants: DataFrame, as_of: int, at: str = "at") -> DataFrame:
    """Rows inside their tenant's retention; rows of unknown tenants are kept."""
    days = plan_defaults(tenants).select("tenant_id", "retention_days")
    joined = df.join(days, "tenant_id", "left")
    oldest = F.lit(as_of) - F.col("retention_days").cast("bigint") * 86_400_000_000
    return joined.filter(F.col("retention_days").isNull() | (F.col(at) >= oldest)).drop("retention_days")
