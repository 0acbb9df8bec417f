"""Domain views over the driver's tables, as SQL text that Spark and DuckDB both run.

{table} stands for a table; {epoch_us} and {micros} for the engine's function to microseconds.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

NOTES = """
SELECT o_orderkey AS note_id,
  'Seen ' || cast(cast(o_orderdate AS date) AS string) || '. MRN: ' || cast(10000000 + o_custkey AS string)
  || ', SSN ' || lpad(cast(1 + o_orderkey % 665 AS string), 3, '0') || '-' || lpad(cast(1 + o_orderkey % 99 AS string), 2, '0') || '-' || lpad(cast(1 + o_orderkey % 9999 AS string), 4, '0')
  || '. Call 617-555-' || lpad(cast(o_custkey % 10000 AS string), 4, '0') || ' or write c' || cast(o_custkey AS string) || '@example.com. NPI: 5' || lpad(cast(o_custkey AS string), 9, '0')
  || ', DEA AB' || lpad(cast(o_orderkey % 10000000 AS string), 7, '0') || '. Home 02139-' || lpad(cast(o_custkey % 10000 AS string), 4, '0')
  || ', see https://portal.example.org/p/' || cast(o_orderkey AS string) || ' from 10.0.' || cast(o_custkey % 256 AS string) || '.' || cast(o_orderkey % 256 AS string) || ' today' AS text
FROM {orders}
"""

AUDIT = """
SELECT 'c' || cast(conv_id AS string) AS session_id, cast(turn + 1 AS bigint) AS sequence_number,
  'c' || cast(conv_id AS string) || '-' || cast(turn + 1 AS string) AS event_id,
  CASE role WHEN 'system' THEN 'session_start' WHEN 'user' THEN 'agent_llm_call' ELSE 'agent_llm_response' END AS event_type,
  CASE role WHEN 'system' THEN 'unknown' ELSE role END AS agent_id,
  'h' || cast(length(coalesce(text, '')) AS string) AS input_hash,
  cast(NULL AS string) AS risk_tier, cast(NULL AS double) AS confidence_score,
  cast((1704067200 + conv_id * 3600 + turn) * 1000000 AS bigint) AS ts_us
FROM {conversations}
"""

ACTIONS = """
SELECT 'u' || cast(user_id AS string) AS session_id,
  cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS bigint) AS sequence_number,
  'e' || cast(event_id AS string) AS event_id,
  CASE WHEN event_type = 'click' THEN 'tool_call' WHEN event_type = 'purchase' THEN 'escalation_triggered' WHEN event_type = 'signup' THEN 'human_review_response'
       WHEN event_type = 'error' THEN 'module_error' WHEN event_id % 3 = 0 THEN 'phi_redacted' ELSE 'phi_detected' END AS event_type,
  CASE WHEN event_id % 11 = 0 THEN 'unknown' ELSE 'agent' || cast(event_id % 4 AS string) END AS agent_id,
  'h' || cast(event_id % 1000 AS string) AS input_hash,
  CASE event_id % 3 WHEN 0 THEN 'informational' WHEN 1 THEN 'advisory' ELSE 'interventional' END AS risk_tier,
  CASE WHEN event_id % 5 = 0 THEN cast(NULL AS double) ELSE least(cast(floor(value) AS double) / 100, cast(1 AS double)) END AS confidence_score,
  cast({micros}(ts) AS bigint) AS ts_us
FROM {events}
"""

ALL = f"SELECT * FROM ({AUDIT}) UNION ALL SELECT * FROM ({ACTIONS})"

CALIBRATION = "SELECT doc_id, cast((doc_id * 37) % 101 AS double) / 100 AS confidence, quality = 1 AS correct FROM {labels}"

REASONS = """
SELECT event_id, 'Step done. Confidence: ' || cast(event_id * 7 % 120 AS string) || '% and then ' || cast(event_id * 13 % 100 AS string) || ' % confident' AS reasoning,
  CASE event_id % 4 WHEN 0 THEN 'Amoxicillin for E11.9' WHEN 1 THEN 'Metformin ZZZZ for I10 and Q99.Z' WHEN 2 THEN 'no drugs' ELSE 'Lisinopril E11.9 I10' END AS output,
  event_id % 3 AS provided
FROM {events}
"""

QUEUE = "SELECT event_id, cast({micros}(ts) AS bigint) AS at_us, user_id FROM {events} WHERE event_type = 'purchase'"

_TABLE = re.compile(r"\{(region|nation|customer|supplier|part|orders|lineitem|events|documents|embeddings|pages|benchmark|labels|conversations)\}")


def spark_view(spark: SparkSession, sf_dir: str, sql: str, deal: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """A view's rows; only the tables that it names are read, and dealt out before the view's text is made of them."""
    sql = sql.replace("{micros}", "unix_micros")
    names = set(_TABLE.findall(sql))
    tables = {}
    for n in names:
        df = spark.read.parquet(f"{sf_dir}/{n}.parquet")
        for c, kind in df.dtypes:
            if kind == "timestamp_ntz":
                df = df.withColumn(c, df[c].cast("timestamp"))
        tables[n] = deal(df)
    return spark.sql(sql, **tables)


def duck(sql: str) -> str:
    """A view's SQL for DuckDB."""
    return _TABLE.sub(r"\1", sql.replace("{micros}", "epoch_us"))
