"""Dashboard aggregates and short lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.fields import beside
from wardline.functions.risk import SEVERITIES
from wardline.operators.slices import newest

# Rule words of insider alerts.
INSIDER_RULES = ["bulk_download", "privilege_escalation", "behavior_unusual_location", "behavior_rare_action"]


def severity_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def threat_count(df: DataFrame) -> DataFrame:
    """One row: critical, high, and both together."""
    return df.agg(
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "high").alias("high"),
        F.count_if(F.col("severity").isin("critical", "high")).alias("threats"),
    )


def soc_kpis(events: DataFrame, incidents: DataFrame, baselines: DataFrame, at: str = "at") -> DataFrame:
    """One row of headline numbers."""
    seen = events.agg(F.count(F.lit(1)).alias("events"), F.max(at).alias("last_event_at"))
    profiled = baselines.agg(F.count(F.lit(1)).alias("users_profiled"))
    return beside(beside(seen, threat_count(incidents)), profiled)


def top_flows(df: DataFrame, source: str, target: str, limit: int = 25) -> DataFrame:
    """Most frequent (source, target) pairs; pairs with a null are left out."""
    pairs = df.filter(F.col(source).isNotNull() & F.col(target).isNotNull())
    counted = pairs.groupBy(source, target).agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy(F.desc("count"), source, target).limit(limit)


def type_severity_matrix(df: DataFrame) -> DataFrame:
    """Event types by severity, zero where there is none."""
    return (
        df.groupBy("event_type").pivot("severity", SEVERITIES).agg(F.count(F.lit(1))).fillna(0, SEVERITIES)
    )


def technique_counts(df: DataFrame) -> DataFrame:
    return df.select(F.explode("mitre_techniques").alias("technique")).groupBy("technique").agg(F.count(F.lit(1)).alias("n"))


def tactic_counts(df: DataFrame) -> DataFrame:
    return df.select(F.explode("mitre_tactics").alias("tactic")).groupBy("tactic").agg(F.count(F.lit(1)).alias("n"))


def event_type_counts(df: DataFrame, *extra: str) -> DataFrame:
    """Events per type (and per ``extra`` columns)."""
    return df.groupBy("event_type", *extra).agg(F.count(F.lit(1)).alias("n"))


def user_event_counts(df: DataFrame, user: str = "user_name") -> DataFrame:
    named = df.filter(~F.coalesce(F.col(user), F.lit("")).isin("", "unknown"))
    return named.groupBy(user).agg(F.count(F.lit(1)).alias("n"))


def top_threats(df: DataFrame, limit: int = 20, tie: str = "seq") -> DataFrame:
    threats = df.filter(F.col("severity").isin("critical", "high"))
    return threats.orderBy(F.desc("risk_score"), tie).limit(limit)


def recent(df: DataFrame, limit: int = 50, columns: list[str] | None = None, at: str = "at", tie: str = "seq") -> DataFrame:
    """The last ``limit`` rows in time order, projected."""
    wanted = df.select(*dict.fromkeys([*(columns or df.columns), at, tie]))
    return newest(wanted, [], at, [tie], limit).orderBy(at, tie)


def risk_trend(df: DataFrame, limit: int = 100, at: str = "at", tie: str = "seq") -> DataFrame:
    return recent(df, limit, [at, "risk_score", "severity"], at, tie)


def load_recent(network: DataFrame, auth: DataFrame, limit: int, at: str = "at", tie: str = "seq") -> DataFrame:
    """The tails of both logs, network first, then the tail of that list."""
    both = newest(network, [], at, [tie], limit).withColumn("_log", F.lit(0)).unionByName(
        newest(auth, [], at, [tie], limit).withColumn("_log", F.lit(1)), allowMissingColumns=True
    )
    # At most two limits of rows remain here.
    return both.orderBy(F.desc("_log"), F.desc(at), F.desc(tie)).limit(limit).drop("_log")


def rules_overlap(words: list[str], rules: str = "triggered_rules") -> Column:
    """True when any rule name contains one of the words."""
    return F.exists(rules, lambda rule: F.lit(False) if not words else rule.rlike("|".join(words)))


def sensitive_access(df: DataFrame) -> DataFrame:
    return df.filter(rules_overlap(["sensitive_file_access"]))


def insider_alerts(df: DataFrame) -> DataFrame:
    return df.filter(rules_overlap(INSIDER_RULES))


def pipeline_metrics(df: DataFrame) -> DataFrame:
    """Counters per tenant, source and component."""
    return df.groupBy("tenant_id", "source", "component").agg(
        F.count_if(F.col("outcome") == "ingested").alias("ingested"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
        F.count_if(F.col("outcome") == "dead_letter").alias("dead_lettered"),
    )
