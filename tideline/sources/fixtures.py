"""Logs and requests derived from the test tables, as SQL that any engine reads the same way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Table names in braces; text columns k and v become key and value bytes.
SQL = {
    "events": """SELECT event_id + 1 AS seq, 0 AS op_idx, 1 AS ns, concat('user:', user_id) AS k,
  CASE WHEN event_type = 'error' THEN 'delete' ELSE 'set' END AS op,
  CASE WHEN event_type = 'error' THEN NULL ELSE concat(event_type, '#', event_id) END AS v,
  CAST(0 AS BIGINT) AS expected_seq FROM {events}""",
    "events_cas": """SELECT seq, op_idx, ns, k, op, v,
  CASE WHEN event_type = 'purchase' THEN coalesce(CASE WHEN event_id % 3 = 0 THEN l2 ELSE l1 END, 0) ELSE 0 END AS expected_seq
FROM (SELECT event_id, event_type, event_id + 1 AS seq, 0 AS op_idx, 1 AS ns, concat('user:', user_id) AS k,
  CASE WHEN event_type = 'error' THEN 'delete' ELSE 'set' END AS op,
  CASE WHEN event_type = 'error' THEN NULL ELSE concat(event_type, '#', event_id) END AS v,
  lag(event_id + 1, 1) OVER (PARTITION BY user_id ORDER BY event_id) AS l1,
  lag(event_id + 1, 2) OVER (PARTITION BY user_id ORDER BY event_id) AS l2 FROM {events}) t""",
    "lineitem": """SELECT l_orderkey + 1 AS seq,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS op_idx,
  2 AS ns, concat('part:', lpad(CAST(l_partkey AS VARCHAR(20)), 8, '0')) AS k,
  CASE WHEN l_returnflag = 'R' THEN 'delete' ELSE 'set' END AS op,
  CASE WHEN l_returnflag = 'R' THEN NULL ELSE concat('s', l_suppkey, '/', l_linenumber) END AS v,
  CAST(0 AS BIGINT) AS expected_seq FROM {lineitem}""",
    "two_ns": """SELECT 2 * event_id + 1 AS seq, 0 AS op_idx, 1 AS ns, concat('id:', user_id) AS k,
  CASE WHEN event_type = 'error' THEN 'delete' ELSE 'set' END AS op,
  CASE WHEN event_type = 'error' THEN NULL ELSE concat('e', event_id) END AS v, CAST(0 AS BIGINT) AS expected_seq FROM {events}
UNION ALL SELECT 2 * o_orderkey + 2, 0, 2, concat('id:', o_custkey),
  CASE WHEN o_orderstatus = 'F' THEN 'delete' ELSE 'set' END,
  CASE WHEN o_orderstatus = 'F' THEN NULL ELSE concat('o', o_orderkey) END, CAST(0 AS BIGINT) FROM {orders}""",
    "partitions": """SELECT event_id + 1 AS seq, CAST((event_id + 1) % 4 AS INT) AS part, concat('user:', user_id) AS k FROM {events}
UNION ALL SELECT event_id + 1, CAST((event_id + 2) % 4 AS INT), concat('user:', user_id) FROM {events} WHERE (event_id + 1) % 10 = 0""",
    "submissions": """SELECT event_id AS arrival, user_id AS client_id,
  CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) / 2.0) AS BIGINT) AS client_seq FROM {events}""",
    "get_requests": "SELECT c_custkey AS req_idx, 1 AS ns, concat('user:', c_custkey % 200) AS k, (c_custkey * 37) % 900 AS at_seq FROM {customer}",
    "range_requests": "SELECT CAST(n_nationkey AS BIGINT) AS req_idx, 1 AS ns, concat('user:', n_nationkey) AS a, concat('user:', n_nationkey, '~') AS b, n_nationkey % 4 AS lim FROM {nation}",
    "log_health": "SELECT event_id + 1 AS seq, concat('user:', user_id) AS k, (event_id + 1) % 997 <> 0 AS ok FROM {events}",
    "doc_values": """SELECT doc_id + 1 AS seq, 0 AS op_idx, 3 AS ns, concat(lang, ':', doc_id) AS k, 'set' AS op, text AS v, CAST(0 AS BIGINT) AS expected_seq FROM {documents}
WHERE lang IS NOT NULL AND text IS NOT NULL""",
    "latency_samples": "SELECT CAST(floor(value * 20000) AS BIGINT) AS ns FROM {events} WHERE value IS NOT NULL",
    "subscribers": "SELECT * FROM (VALUES (1, CAST(NULL AS INT), CAST(0 AS BIGINT)), (2, 1, CAST(500 AS BIGINT)), (3, 2, CAST(1200 AS BIGINT))) AS t(sub_id, ns_filter, cursor)",
}
TABLES = ("events", "lineitem", "orders", "customer", "nation", "documents")


def sql(name: str) -> str:
    """The fixture's SQL over tables of their own names."""
    return SQL[name].format(**{t: t for t in TABLES})


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in SQL[name]}
    df = spark.sql(SQL[name], **used)
    for text, raw in (("k", "key"), ("v", "value"), ("a", "start"), ("b", "end")):
        if text in df.columns:
            df = df.withColumn(text, F.col(text).cast("binary")).withColumnRenamed(text, raw)
    return df


def as_log(ops: DataFrame, partitions: int = 4) -> DataFrame:
    """A LOG of operations: one transaction per seq."""
    op = F.struct(F.col("op_idx").cast("int").alias("op_idx"), F.col("ns").cast("int").alias("ns"), "op", "key", "value", F.col("expected_seq").cast("long").alias("expected_seq"))
    each = ops.groupBy("seq").agg(F.array_sort(F.collect_list(op)).alias("ops"))
    return each.select("seq", F.lit(0).cast("long").alias("epoch"), F.lit("txn_intent").alias("kind"), F.pmod("seq", F.lit(partitions)).cast("int").alias("partition"), F.lit(1).cast("long").alias("client_id"), F.col("seq").alias("client_seq"), "ops")
