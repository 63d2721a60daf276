"""The test tables, and the security-event view over ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DAY = 86_400_000_000

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def security_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` read as security telemetry; ``at`` is the event time in microseconds."""
    keyed = table(spark, sf_dir, "events").selectExpr("*", "CAST(get_json_object(props, '$.k') AS INT) AS k")
    return keyed.selectExpr(
        "CAST(event_id AS STRING) AS event_id",
        "event_id AS seq",
        "CAST(ts AS TIMESTAMP) AS ts",
        "unix_micros(CAST(ts AS TIMESTAMP)) AS at",
        "concat('t', user_id % 5) AS tenant_id",
        "concat('h', user_id % 20) AS host",
        "concat('u', user_id) AS user_name",
        """CASE event_type WHEN 'error' THEN 'login_failure' WHEN 'signup' THEN 'process_create'
           WHEN 'view' THEN 'network_connection' WHEN 'purchase' THEN 'anomaly' ELSE 'login_success' END AS event_type""",
        """CASE WHEN event_type IN ('error', 'click') THEN 'auth' WHEN event_type = 'view' THEN 'network'
           WHEN event_type = 'signup' THEN 'process' ELSE 'system' END AS source""",
        "CASE WHEN value >= 150 THEN 'critical' WHEN value >= 75 THEN 'high' WHEN value >= 25 THEN 'medium' ELSE 'low' END AS severity",
        "CASE k % 10 WHEN 0 THEN 'brute_force' WHEN 1 THEN 'ddos' WHEN 2 THEN 'insider_threat' ELSE 'none' END AS attack_type",
        "concat('10.0.', k % 4, '.', k) AS ip_address",
        "concat('d', k % 7) AS device",
        "CAST(event_id % 500 + 1 AS INT) AS pid",
        "CAST((event_id * 7) % 500 AS INT) AS parent_pid",
        "value",
        "k",
    )


# The same view for the SQL twins.
SEC = """sec AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, event_id AS seq, ts, epoch_us(ts) AS us,
    't' || CAST(user_id % 5 AS VARCHAR) AS tenant_id,
    'h' || CAST(user_id % 20 AS VARCHAR) AS host,
    'u' || CAST(user_id AS VARCHAR) AS user_name,
    CASE event_type WHEN 'error' THEN 'login_failure' WHEN 'signup' THEN 'process_create'
      WHEN 'view' THEN 'network_connection' WHEN 'purchase' THEN 'anomaly' ELSE 'login_success' END AS event_type,
    CASE WHEN event_type IN ('error','click') THEN 'auth' WHEN event_type = 'view' THEN 'network'
      WHEN event_type = 'signup' THEN 'process' ELSE 'system' END AS source,
    CASE WHEN value >= 150 THEN 'critical' WHEN value >= 75 THEN 'high' WHEN value >= 25 THEN 'medium' ELSE 'low' END AS severity,
    CASE k % 10 WHEN 0 THEN 'brute_force' WHEN 1 THEN 'ddos' WHEN 2 THEN 'insider_threat' ELSE 'none' END AS attack_type,
    '10.0.' || CAST(k % 4 AS VARCHAR) || '.' || CAST(k AS VARCHAR) AS ip_address,
    'd' || CAST(k % 7 AS VARCHAR) AS device,
    CAST(event_id % 500 + 1 AS INTEGER) AS pid, CAST((event_id * 7) % 500 AS INTEGER) AS parent_pid,
    value, k
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
)"""
