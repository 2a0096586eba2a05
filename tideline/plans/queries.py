"""The named queries of the log engine and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.keys import in_range
from ..operators import cdc, fold, maintenance, reads, sequencing
from ..session import new_folder, stored
from ..sources import store
from ..sources.fixtures import as_log, fixture, sql
from ..streaming import fold_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
AT, EARLY = 5000, 300


def _query(name: str, oracle: str, *fixtures: str):
    """Registers a query; `oracle` reads fixtures as CTEs of their names."""

    def put(f):
        QUERIES[name] = f
        ctes = ", ".join(f"{x} AS ({sql(x)})" for x in fixtures)
        ORACLE_SQL[name] = f"WITH RECURSIVE {ctes}\n{oracle}" if ctes else oracle
        return f

    return put


def _text(df: DataFrame) -> DataFrame:
    names = {"key": "k", "value": "v"}
    return df.select(*[F.col(c).cast("string").alias(names.get(c, c)) if t == "binary" else F.col(c) for c, t in df.dtypes])


def _plain(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """Judged operations of a log without conditional sets."""
    return fold.judged(fixture(spark, sf_dir, name), conditional=False)


def _versions(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    return fold.versions(_plain(spark, sf_dir, name))


def _cas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.judged(fixture(spark, sf_dir, "events_cas"))


_NEWEST = "SELECT ns, k, v, seq, op FROM (SELECT *, row_number() OVER (PARTITION BY ns, k ORDER BY seq DESC, op_idx DESC) AS rn FROM {0} WHERE {1}) WHERE rn = 1"


def _live(log: str = "events", where: str = "TRUE") -> str:
    # the log's CTE hides the table of its name behind it
    return f"(SELECT ns, k, v, seq FROM ({_NEWEST.format(log, where)}) WHERE op = 'set')"


# conditional sets, one operation after another
_CAS = """, steps AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq) AS n FROM events_cas),
run(k, n, seq, op, v, expected_seq, ok, before, live, cur) AS (
  SELECT k, n, seq, op, v, expected_seq, expected_seq = 0, CAST(NULL AS VARCHAR), CASE WHEN op = 'set' AND expected_seq = 0 THEN seq END, CASE WHEN op = 'set' AND expected_seq = 0 THEN v END FROM steps WHERE n = 1
  UNION ALL
  SELECT s.k, s.n, s.seq, s.op, s.v, s.expected_seq, s.expected_seq = 0 OR coalesce(s.expected_seq = r.live, FALSE), r.cur,
    CASE WHEN s.expected_seq = 0 OR coalesce(s.expected_seq = r.live, FALSE) THEN CASE WHEN s.op = 'set' THEN s.seq END ELSE r.live END,
    CASE WHEN s.expected_seq = 0 OR coalesce(s.expected_seq = r.live, FALSE) THEN CASE WHEN s.op = 'set' THEN s.v END ELSE r.cur END
  FROM run r JOIN steps s ON s.k = r.k AND s.n = r.n + 1)"""


@_query("state_latest", f"SELECT k, v, seq FROM {_live()} ORDER BY k", "events")
def state_latest(spark, sf_dir):
    return _text(fold.state(_versions(spark, sf_dir)).select("key", "value", "seq").orderBy("key"))


@_query("state_at_seq", f"SELECT k, v, seq FROM {_live(where=f'seq <= {AT}')}", "events")
def state_at_seq(spark, sf_dir):
    return _text(fold.state(_versions(spark, sf_dir), AT).select("key", "value", "seq"))


_GET = "SELECT (SELECT nullif(v, '') FROM {0} WHERE k = 'user:7') AS v, coalesce((SELECT seq FROM {0} WHERE k = 'user:7'), 0)::BIGINT AS committed_seq"


@_query("get_point", _GET.format(_live()), "events")
def get_point(spark, sf_dir):
    return _text(reads.get(_versions(spark, sf_dir), "user:7"))


@_query("get_as_of", _GET.format(_live(where=f"seq <= {EARLY}")), "events")
def get_as_of(spark, sf_dir):
    return _text(reads.get(_versions(spark, sf_dir), "user:7", EARLY))


@_query("get_missing", "SELECT CAST(NULL AS VARCHAR) AS v, 0::BIGINT AS committed_seq FROM (SELECT count(*) FROM events)", "events")
def get_missing(spark, sf_dir):
    return _text(reads.get(_versions(spark, sf_dir), "nobody"))


@_query("multi_get", f"SELECT r.req_idx, r.ns, r.k, s.seq IS NOT NULL AS found, s.v, coalesce(s.seq, 0)::BIGINT AS committed_seq FROM get_requests r LEFT JOIN {_live()} s USING (ns, k)", "events", "get_requests")
def multi_get(spark, sf_dir):
    return _text(reads.multi_get(_versions(spark, sf_dir), fixture(spark, sf_dir, "get_requests")))


@_query(
    "multi_get_as_of",
    """, hit AS (SELECT r.req_idx, e.op, e.v, e.seq, row_number() OVER (PARTITION BY r.req_idx ORDER BY e.seq DESC) AS rn FROM get_requests r JOIN events e ON e.ns = r.ns AND e.k = r.k AND e.seq <= r.at_seq),
top AS (SELECT * FROM hit WHERE rn = 1 AND op = 'set')
SELECT r.req_idx, r.ns, r.k, r.at_seq, t.seq IS NOT NULL AS found, t.v, coalesce(t.seq, 0)::BIGINT AS committed_seq FROM get_requests r LEFT JOIN top t USING (req_idx)""",
    "events",
    "get_requests",
)
def multi_get_as_of(spark, sf_dir):
    return _text(reads.multi_get_as_of(_versions(spark, sf_dir), fixture(spark, sf_dir, "get_requests")))


_RANGE = "SELECT ns, k, v, seq FROM {0} WHERE k >= 'user:1' AND k < 'user:2' ORDER BY k"


@_query("range_scan", _RANGE.format(_live()), "events")
def range_scan(spark, sf_dir):
    return _text(reads.range_scan(_versions(spark, sf_dir), "user:1", "user:2").select("ns", "key", "value", "seq"))


@_query("range_limit", _RANGE.format(_live()) + " LIMIT 5", "events")
def range_limit(spark, sf_dir):
    return _text(reads.range_scan(_versions(spark, sf_dir), "user:1", "user:2", limit=5).select("ns", "key", "value", "seq"))


@_query("range_at_seq", _RANGE.format(_live(where=f"seq <= {EARLY}")), "events")
def range_at_seq(spark, sf_dir):
    return _text(reads.range_scan(_versions(spark, sf_dir), "user:1", "user:2", at_seq=EARLY).select("ns", "key", "value", "seq"))


@_query("range_unbounded", f"SELECT ns, k, v, seq FROM {_live()} WHERE k > 'user:50' ORDER BY k", "events")
def range_unbounded(spark, sf_dir):
    return _text(reads.range_scan(_versions(spark, sf_dir), "user:50", None, start_inclusive=False).select("ns", "key", "value", "seq"))


_RANGES = f"""SELECT req_idx, ns, k, v, seq, place::INT AS place FROM (SELECT r.req_idx, s.ns, s.k, s.v, s.seq, r.lim, row_number() OVER (PARTITION BY r.req_idx ORDER BY s.k) AS place
FROM range_requests r JOIN {_live()} s ON s.ns = r.ns AND s.k >= r.a AND s.k < r.b) WHERE lim = 0 OR place <= lim"""


@_query("range_batch", _RANGES, "events", "range_requests")
def range_batch(spark, sf_dir):
    return _text(reads.range_batch(_versions(spark, sf_dir), fixture(spark, sf_dir, "range_requests")))


@_query(
    "read_batch",
    f""", hit AS (SELECT r.req_idx, e.op, e.v, e.seq, row_number() OVER (PARTITION BY r.req_idx ORDER BY e.seq DESC) AS rn FROM get_requests r JOIN events e ON e.ns = r.ns AND e.k = r.k AND e.seq <= r.at_seq),
top AS (SELECT * FROM hit WHERE rn = 1 AND op = 'set')
SELECT r.req_idx, 'get' AS kind, r.ns, r.k, t.seq IS NOT NULL AS found, t.v, coalesce(t.seq, 0)::BIGINT AS seq, 1 AS place FROM get_requests r LEFT JOIN top t USING (req_idx)
UNION ALL SELECT r.req_idx, 'range', r.ns, x.k, x.k IS NOT NULL, x.v, coalesce(x.seq, 0)::BIGINT, coalesce(x.place, 0) FROM range_requests r LEFT JOIN ({_RANGES}) x USING (req_idx)""",
    "events",
    "get_requests",
    "range_requests",
)
def read_batch(spark, sf_dir):
    return _text(reads.read_batch(_versions(spark, sf_dir), fixture(spark, sf_dir, "get_requests"), fixture(spark, sf_dir, "range_requests")))


@_query("scatter_scan", f"SELECT ns, k, v, seq FROM {_live()}", "events")
def scatter_scan(spark, sf_dir):
    return _text(reads.scatter_scan(_versions(spark, sf_dir), 4).select("ns", "key", "value", "seq"))


@_query("keys_deleted", f"SELECT k, seq FROM ({_NEWEST.format('events', 'TRUE')}) WHERE op = 'delete'", "events")
def keys_deleted(spark, sf_dir):
    return _text(fold.newest(_versions(spark, sf_dir)).filter("is_tombstone").select("key", "seq"))


@_query("version_history", "SELECT k, seq, v, op = 'delete' AS is_tombstone, coalesce(lag(seq) OVER w, 0) AS before_seq, lag(v) OVER w AS before_value FROM events WINDOW w AS (PARTITION BY ns, k ORDER BY seq)", "events")
def version_history(spark, sf_dir):
    h = reads.history(_versions(spark, sf_dir))
    return _text(h.select("key", "seq", "value", "is_tombstone", F.coalesce("before.seq", F.lit(0)).alias("before_seq"), F.col("before.value").alias("before_value")))


_LAST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seq, ns, k ORDER BY op_idx DESC) AS rn FROM lineitem) WHERE rn = 1)"


@_query("txn_coalesce", f"SELECT seq, op_idx::INT AS op_idx, ns, k, op, v, expected_seq FROM {_LAST}", "lineitem")
def txn_coalesce(spark, sf_dir):
    return _text(fold.coalesce_ops(fixture(spark, sf_dir, "lineitem")).select("seq", "op_idx", "ns", "key", "op", "value", "expected_seq"))


@_query("batch_atomic_state", f"SELECT ns, k, v, seq FROM {_live('lineitem')}", "lineitem")
def batch_atomic_state(spark, sf_dir):
    log = as_log(fixture(spark, sf_dir, "lineitem"))
    return _text(fold.fold(log, conditional=False).select("ns", "key", "value", "seq"))


@_query("binary_values", "SELECT ns, k, hex(encode(v)) AS hex_value, seq FROM doc_values", "doc_values")
def binary_values(spark, sf_dir):
    s = fold.state(_versions(spark, sf_dir, "doc_values"))
    return s.select("ns", F.col("key").cast("string").alias("k"), F.hex("value").alias("hex_value"), "seq")


@_query("request_errors", "SELECT seq, op_idx::INT AS op_idx, ns, k, op, 'conditional operation in a batch' AS reason FROM (SELECT *, count(*) OVER (PARTITION BY seq) AS n FROM lineitem) WHERE n > 1 AND op = 'set'", "lineitem")
def request_errors(spark, sf_dir):
    ops = fixture(spark, sf_dir, "lineitem").withColumn("expected_seq", F.when(F.col("op") == "set", 1).otherwise(0).cast("long"))
    return _text(fold.check_requests(ops))


@_query("cas_outcome", f"{_CAS} SELECT seq, CASE WHEN ok THEN 'ok' ELSE 'abort' END AS status, CASE WHEN NOT ok THEN 'constraint_violation' END AS code, CASE WHEN ok THEN 1 ELSE 0 END::BIGINT AS rows_affected FROM run", "events_cas")
def cas_outcome(spark, sf_dir):
    return fold.outcomes(_cas(spark, sf_dir))


@_query(
    "cas_response",
    f"{_CAS}, cur AS (SELECT *, lag(live) OVER (PARTITION BY k ORDER BY n) AS had FROM run) SELECT seq, k, ok, CASE WHEN ok THEN seq ELSE coalesce(had, 0) END AS committed_seq, CASE WHEN NOT ok THEN coalesce(had, 0) ELSE -1 END AS cas_failed FROM cur WHERE expected_seq > 0",
    "events_cas",
)
def cas_response(spark, sf_dir):
    return _text(fold.responses(_cas(spark, sf_dir)).select("seq", "key", "ok", "committed_seq", F.coalesce("cas_failed", F.lit(-1)).alias("cas_failed")))


@_query("state_latest_cas", f"{_CAS} SELECT k, cur AS v, live AS seq FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC) AS rn FROM run) WHERE rn = 1 AND live IS NOT NULL", "events_cas")
def state_latest_cas(spark, sf_dir):
    return _text(fold.state(fold.versions(_cas(spark, sf_dir))).select("key", "value", "seq"))


@_query(
    "txn_outcome_counts",
    f"{_CAS} SELECT CASE WHEN ok THEN 'ok' ELSE 'abort' END AS status, count(*) AS txns, sum(CASE WHEN ok THEN 1 ELSE 0 END)::BIGINT AS rows_affected FROM run GROUP BY 1",
    "events_cas",
)
def txn_outcome_counts(spark, sf_dir):
    return fold.outcomes(_cas(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("txns"), metrics.counter(F.col("rows_affected")).alias("rows_affected"))


@_query(
    "txn_noop_abort",
    "SELECT event_id + 1 AS seq, CASE WHEN event_id % 10 = 0 THEN 'noop' WHEN event_id % 10 = 1 THEN 'abort' ELSE 'ok' END AS status, CASE WHEN event_id % 10 = 1 THEN 'bad_payload' END AS code, CASE WHEN event_id % 10 < 2 THEN 0 ELSE 1 END::BIGINT AS rows_affected FROM events",
)
def txn_noop_abort(spark, sf_dir):
    log = as_log(fixture(spark, sf_dir, "events")).withColumn("kind", F.when(F.col("seq") % 10 == 1, "snapshot_marker").otherwise("txn_intent"))
    log = log.withColumn("payload_ok", F.col("seq") % 10 != 2)
    return fold.outcomes(fold.judged(fold.operations(log.filter("payload_ok")), conditional=False), log)


@_query(
    "fold_metrics",
    "SELECT count(*) FILTER (event_id % 10 > 1) AS applied, count(*) FILTER (event_id % 10 = 1) AS aborted, count(*) FILTER (event_id % 10 = 0) AS noops, count(*) FILTER (event_id % 10 > 1)::BIGINT AS rows_affected, coalesce(max(event_id + 1), 0)::BIGINT AS current_seq, 90::BIGINT AS lag FROM events",
)
def fold_metrics(spark, sf_dir):
    done = txn_noop_abort(spark, sf_dir)
    head = done.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] + 90
    return metrics.fold_metrics(done, head)


@_query("cdc_effects", f"{_CAS} SELECT seq, 1 AS ns, k, CASE WHEN op = 'delete' THEN 'delete' ELSE 'update' END AS op, before, CASE WHEN op = 'set' THEN v END AS after FROM run WHERE ok", "events_cas")
def cdc_effects(spark, sf_dir):
    e = _text(cdc.effects(_cas(spark, sf_dir)))
    return e.select("seq", "ns", "k", "op", "before", "after")


_EFFECT = "op || ' ' || k || '=' || coalesce(before, '-') || '>' || coalesce(after, '-')"


@_query(
    "cdc_events",
    f""", f AS (SELECT seq, op_idx, k, CASE WHEN op = 'delete' THEN 'delete' ELSE 'update' END AS op, lag(v) OVER (PARTITION BY ns, k ORDER BY seq) AS before, v AS after FROM {_LAST})
SELECT seq, count(*) AS effects, string_agg({_EFFECT}, ',' ORDER BY op_idx) AS listed FROM f GROUP BY seq""",
    "lineitem",
)
def cdc_events(spark, sf_dir):
    e = cdc.events(cdc.effects(_plain(spark, sf_dir, "lineitem")))
    listed = "concat_ws(',', transform(effects, e -> concat(e.op, ' ', CAST(e.key AS STRING), '=', coalesce(CAST(e.before AS STRING), '-'), '>', coalesce(CAST(e.after AS STRING), '-'))))"
    return e.select("seq", F.size("effects").cast("long").alias("effects"), F.expr(listed).alias("listed"))


_TWO = "(SELECT seq, ns, k, CASE WHEN op = 'delete' THEN 'delete' ELSE 'update' END AS op, lag(v) OVER (PARTITION BY ns, k ORDER BY seq) AS before, v AS after FROM two_ns)"


def _two(spark, sf_dir):
    return cdc.effects(_plain(spark, sf_dir, "two_ns"))


@_query("cdc_from_seq", f"SELECT * FROM {_TWO} WHERE seq > 1200", "two_ns")
def cdc_from_seq(spark, sf_dir):
    return _text(cdc.filtered(_two(spark, sf_dir), from_seq=1200).select("seq", "ns", "key", "op", "before", "after"))


@_query("cdc_namespace_filter", f"SELECT * FROM {_TWO} WHERE ns = 2", "two_ns")
def cdc_namespace_filter(spark, sf_dir):
    return _text(cdc.filtered(_two(spark, sf_dir), ns=2).select("seq", "ns", "key", "op", "before", "after"))


@_query("cdc_deliveries", f"SELECT sub_id, seq, count(*)::BIGINT AS effects FROM {_TWO} e JOIN subscribers s ON (s.ns_filter IS NULL OR s.ns_filter = e.ns) AND e.seq > s.cursor GROUP BY 1, 2", "two_ns", "subscribers")
def cdc_deliveries(spark, sf_dir):
    return cdc.deliveries(_two(spark, sf_dir), fixture(spark, sf_dir, "subscribers"))


@_query("cdc_next", f"SELECT 2 AS sub_id, seq, count(*)::BIGINT AS effects FROM {_TWO} WHERE ns = 1 AND seq > 500 GROUP BY seq ORDER BY seq LIMIT 20", "two_ns")
def cdc_next(spark, sf_dir):
    return cdc.next_events(_two(spark, sf_dir), fixture(spark, sf_dir, "subscribers").filter("sub_id = 2"), 20)


@_query("cdc_unsubscribe", "SELECT sub_id, cursor FROM subscribers WHERE sub_id <> 2", "subscribers")
def cdc_unsubscribe(spark, sf_dir):
    return cdc.unsubscribe(fixture(spark, sf_dir, "subscribers"), 2).select("sub_id", "cursor")


@_query("cdc_min_cursor", "SELECT coalesce(min(CASE WHEN sub_id = 1 THEN greatest(cursor, 700) ELSE cursor END), 0)::BIGINT AS min_cursor FROM subscribers", "subscribers")
def cdc_min_cursor(spark, sf_dir):
    return cdc.min_cursor(cdc.acknowledge(fixture(spark, sf_dir, "subscribers"), 1, 700))


@_query("seq_assign", "SELECT o_orderkey AS arrival, row_number() OVER (ORDER BY o_orderkey) + 100 AS seq, CAST((row_number() OVER (ORDER BY o_orderkey) + 100) % 4 AS INT) AS partition FROM orders")
def seq_assign(spark, sf_dir):
    arrivals = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("arrival"))
    return sequencing.assign(arrivals, next_seq=101, partitions=4)


@_query(
    "idempotent_submit",
    ", f AS (SELECT client_id, client_seq, min(arrival) AS a FROM submissions GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (ORDER BY a) AS seq FROM f) SELECT s.arrival, client_id, client_seq, n.seq, s.arrival > n.a AS duplicate FROM submissions s JOIN n USING (client_id, client_seq)",
    "submissions",
)
def idempotent_submit(spark, sf_dir):
    return sequencing.submit(fixture(spark, sf_dir, "submissions")).select("arrival", "client_id", "client_seq", "seq", "duplicate")


@_query("log_partition_route", "SELECT CAST(seq % 4 AS INT) AS partition, count(*) AS entries, min(seq) AS first_seq, max(seq) AS last_seq FROM events GROUP BY 1", "events")
def log_partition_route(spark, sf_dir):
    return sequencing.partition_loads(sequencing.route_least_loaded(fixture(spark, sf_dir, "events"), 4))


@_query("log_mux_merge", "SELECT seq, min(part) AS part, arg_min(k, part) AS k FROM partitions GROUP BY seq", "partitions")
def log_mux_merge(spark, sf_dir):
    return _text(sequencing.merge(fixture(spark, sf_dir, "partitions")))


@_query("log_mux_window", "SELECT seq, min(part) AS part, arg_min(k, part) AS k FROM partitions WHERE seq >= 50 GROUP BY seq ORDER BY seq LIMIT 40", "partitions")
def log_mux_window(spark, sf_dir):
    return _text(sequencing.merge(fixture(spark, sf_dir, "partitions"), from_seq=50, most=40))


@_query("log_read_from", "SELECT seq, k FROM log_health WHERE seq >= 400 ORDER BY seq LIMIT 256", "log_health")
def log_read_from(spark, sf_dir):
    return _text(sequencing.read(fixture(spark, sf_dir, "log_health").select("seq", "key"), 400, 256))


@_query("log_head", "SELECT max(seq) AS head, 0::BIGINT AS epoch FROM events", "events")
def log_head(spark, sf_dir):
    return sequencing.head(as_log(fixture(spark, sf_dir, "events")))


@_query("log_term_at", "SELECT 0::BIGINT AS term FROM (SELECT count(*) FROM events)", "events")
def log_term_at(spark, sf_dir):
    return sequencing.term_at(as_log(fixture(spark, sf_dir, "events")), 33)


@_query("log_committed", "SELECT max(seq) >= 500 AS committed FROM events", "events")
def log_committed(spark, sf_dir):
    return sequencing.committed(fixture(spark, sf_dir, "events"), 500)


@_query("log_describe_seq", "SELECT seq, 0::BIGINT AS epoch, 'txn_intent' AS kind, 1::BIGINT AS client_id, seq AS client_seq, count(*) FILTER (op = 'set')::INT AS sets, count(*) FILTER (op = 'delete')::INT AS deletes FROM lineitem WHERE seq = 33 GROUP BY seq", "lineitem")
def log_describe_seq(spark, sf_dir):
    return sequencing.describe(as_log(fixture(spark, sf_dir, "lineitem").filter("seq = 33")), 33)


@_query("log_segments", "SELECT CAST(floor((seq - 1) / 1000) AS BIGINT) AS segment, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS entries FROM events GROUP BY 1", "events")
def log_segments(spark, sf_dir):
    return maintenance.segments(fixture(spark, sf_dir, "events"), 1000)


@_query("log_integrity_prefix", "SELECT seq, k FROM log_health WHERE seq < coalesce((SELECT min(seq) FROM log_health WHERE NOT ok), 9223372036854775807)", "log_health")
def log_integrity_prefix(spark, sf_dir):
    return _text(maintenance.valid_prefix(fixture(spark, sf_dir, "log_health")).select("seq", "key"))


@_query("log_integrity_checksum", "SELECT seq, k FROM log_health WHERE seq < coalesce((SELECT min(seq) FROM log_health WHERE NOT ok), 9223372036854775807)", "log_health")
def log_integrity_checksum(spark, sf_dir):
    """Entries whose keys were damaged after their checksum was taken end the valid prefix."""
    log = fixture(spark, sf_dir, "log_health").withColumn("crc", maintenance.checksum(F.col("key")))
    damaged = log.withColumn("key", F.when(F.col("ok"), F.col("key")).otherwise(F.concat(F.col("key"), F.lit("!").cast("binary")))).drop("ok")
    return _text(maintenance.valid_prefix(maintenance.verified(damaged, "crc", "key")).select("seq", "key"))


@_query("log_truncate_prefix", ", g AS (SELECT *, floor((seq - 1) / 100) AS s FROM log_health) SELECT seq, k FROM g WHERE s NOT IN (SELECT s FROM g GROUP BY s HAVING max(seq) < 650)", "log_health")
def log_truncate_prefix(spark, sf_dir):
    return _text(maintenance.truncate_prefix(fixture(spark, sf_dir, "log_health"), 900, snapshot_seq=800, min_cursor=650, size=100).select("seq", "key"))


@_query("log_truncate_suffix", "SELECT seq, k FROM log_health WHERE seq < 700", "log_health")
def log_truncate_suffix(spark, sf_dir):
    return _text(maintenance.truncate_suffix(fixture(spark, sf_dir, "log_health"), 700).select("seq", "key"))


@_query("log_epochs", "SELECT seq, CAST(floor((seq - 1) / 256) AS BIGINT) AS epoch_num, CAST((seq - 1) % 256 + 1 AS INT) AS place FROM events", "events")
def log_epochs(spark, sf_dir):
    return sequencing.epochs(fixture(spark, sf_dir, "events"), 256).select("seq", "epoch_num", "place")


@_query("compact_latest", f"SELECT ns, k, seq, v, op = 'delete' AS is_tombstone FROM ({_NEWEST.format('events', 'TRUE')})", "events")
def compact_latest(spark, sf_dir):
    path, to = new_folder(spark, "versions"), new_folder(spark, "compacted")
    store.write_versions(_versions(spark, sf_dir), path, files=4)
    store.compact_store(spark, path, to)
    return _text(store.read_versions(spark, to))


@_query("compact_retain_history", f"SELECT ns, k, seq, v, op = 'delete' AS is_tombstone FROM ({_NEWEST.format('events', f'seq <= {EARLY}')}) UNION ALL SELECT ns, k, seq, v, op = 'delete' FROM events WHERE seq > {EARLY}", "events")
def compact_retain_history(spark, sf_dir):
    return _text(maintenance.compact(_versions(spark, sf_dir), retain_from=EARLY))


@_query("snapshot_restore_replay", f"SELECT ns, k, v, seq FROM {_live()}", "events")
def snapshot_restore_replay(spark, sf_dir):
    root, versions = new_folder(spark, "snapshots"), stored(_versions(spark, sf_dir), "versions")
    store.snapshot(versions, root, EARLY)
    store.snapshot(versions, root, 600)
    return _text(fold.state(store.recover(spark, root, versions)).select("ns", "key", "value", "seq"))


@_query("recover_cas_tail", f"{_CAS} SELECT k, cur AS v, live AS seq FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC) AS rn FROM run) WHERE rn = 1 AND live IS NOT NULL", "events_cas")
def recover_cas_tail(spark, sf_dir):
    """A snapshot at EARLY, and the log after it folded upon that."""
    root, log = new_folder(spark, "snapshots"), as_log(fixture(spark, sf_dir, "events_cas"))
    store.snapshot(fold.versions(fold.judged(fold.operations(log.filter(F.col("seq") <= EARLY)))), root, EARLY)
    return _text(fold.state(store.recover_from_log(spark, root, log)).select("key", "value", "seq"))


@_query("namespace_isolation", f"SELECT ns, k, v, seq FROM {_live('two_ns')} WHERE k >= 'id:1' AND k < 'id:3'", "two_ns")
def namespace_isolation(spark, sf_dir):
    return _text(fold.state(_versions(spark, sf_dir, "two_ns").filter(in_range(F.col("key"), "id:1", "id:3"))).select("ns", "key", "value", "seq"))


_UPPERS = f"SELECT unnest([{', '.join(map(str, metrics.BOUNDS))}, {metrics.INFINITE}]) AS upper, unnest(range(0, {len(metrics.BOUNDS) + 1}))::INT AS bucket"
_HIST = f", u AS ({_UPPERS}), b AS (SELECT (SELECT min(bucket) FROM u WHERE upper >= ns) AS bucket FROM latency_samples), h AS (SELECT u.bucket, u.upper, count(b.bucket) AS count FROM u LEFT JOIN b USING (bucket) GROUP BY 1, 2)"


@_query("hist_buckets", f"{_HIST} SELECT bucket, upper, count FROM h", "latency_samples")
def hist_buckets(spark, sf_dir):
    return metrics.histogram(fixture(spark, sf_dir, "latency_samples"))


@_query("hist_summary", "SELECT count(*) AS count, sum(ns)::BIGINT AS sum, min(ns) AS min, max(ns) AS max, (sum(ns)::BIGINT // count(*))::BIGINT AS mean FROM latency_samples", "latency_samples")
def hist_summary(spark, sf_dir):
    return metrics.summary(fixture(spark, sf_dir, "latency_samples"))


@_query(
    "hist_percentile",
    f"{_HIST}, c AS (SELECT *, sum(count) OVER (ORDER BY bucket) AS upto, sum(count) OVER () AS n FROM h) SELECT p::INT AS p, min(upper) AS upper FROM c, (SELECT unnest([1, 50, 90, 95, 99, 100]) AS p) WHERE upto >= floor((p * n + 99) / 100) GROUP BY p",
    "latency_samples",
)
def hist_percentile(spark, sf_dir):
    return metrics.percentile(fixture(spark, sf_dir, "latency_samples"), [1, 50, 90, 95, 99, 100])


@_query("gauge_last", "SELECT user_id, arg_max(event_type, event_id) AS last_type, count(*) AS events FROM events GROUP BY 1")
def gauge_last(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy("user_id").agg(metrics.gauge(F.col("event_type"), F.col("event_id")).alias("last_type"), F.count("*").alias("events"))


@_query("stream_fold", f"{_CAS} SELECT seq, k, op = 'set' AS is_set, ok, CASE WHEN ok THEN before END AS before, CASE WHEN ok AND op = 'set' THEN v END AS after FROM run", "events_cas")
def stream_fold(spark, sf_dir):
    """The log in four files, folded as a stream of four micro-batches."""
    source, out, mark = (new_folder(spark, x) for x in ("stream-log", "stream-effects", "stream-checkpoint"))
    ops = fixture(spark, sf_dir, "events_cas").withColumns({"op_idx": F.col("op_idx").cast("int"), "ns": F.col("ns").cast("int")})
    last = ops.agg(F.max("seq")).first()[0] or 0
    step = -(-last // 4)
    for i in range(4):
        ops.filter((F.col("seq") > i * step) & (F.col("seq") <= (i + 1) * step)).select("seq", "op_idx", "ns", "op", "key", "value", "expected_seq").coalesce(1).write.mode("append").parquet(source)
    query = fold_stream.append_effects(fold_stream.fold_stream(fold_stream.read_ops(spark, source, 1)), out, mark)
    query.awaitTermination()
    found = spark.read.schema(fold_stream.OUT).parquet(f"{out}/batch=*")
    return _text(found.select("seq", "key", (F.col("op") == "update").alias("is_set"), "ok", "before", "after"))
