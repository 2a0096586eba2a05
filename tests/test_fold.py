import pytest
from model import fold as model_fold
from model import ops_frame, random_ops

from tideline.errors import InvalidRequest, TooManySubscribers
from tideline.operators import cdc, fold, reads
from tideline.sources.fixtures import as_log


def state_of(df):
    return {(r["ns"], bytes(r["key"])): (r["seq"], bytes(r["value"])) for r in df.collect()}


@pytest.mark.parametrize(("seed", "block"), [(1, 1 << 18), (2, 7), (3, 50)])
def test_random_log_equals_model(spark, seed, block):
    rows = random_ops(600, seed)
    ok, effects, state = model_fold(rows)
    ops = fold.coalesce_ops(ops_frame(spark, rows))
    verdicts = {r["seq"]: r["ok"] for r in fold.conditional_verdicts(ops, block).collect()}
    assert verdicts == {s: ok[s] for s, *_, e in rows if e > 0}
    judged = fold.judged(ops_frame(spark, rows))
    assert state_of(fold.state(fold.versions(judged))) == state
    found = [(r["seq"], r["op_idx"], r["ns"], bytes(r["key"]), r["op"], r["before"] and bytes(r["before"]), r["after"] and bytes(r["after"])) for r in cdc.effects(judged, block).collect()]
    assert sorted(found, key=str) == sorted(effects, key=str)


def test_same_log_in_any_order_and_partitioning(spark):
    rows = random_ops(300, 9)
    frames = [ops_frame(spark, rows).coalesce(1), ops_frame(spark, rows[::-1]).repartition(7)]
    a, b = (state_of(fold.state(fold.versions(fold.judged(f)))) for f in frames)
    assert a == b


def test_long_chain_of_conditional_sets(spark):
    rows = [(1, 0, 1, "set", b"k", b"v", 0)] + [(s, 0, 1, "set", b"k", b"w", s - 1) for s in range(2, 200)]
    assert all(r["ok"] for r in fold.conditional_verdicts(ops_frame(spark, rows)).collect())


def test_conditional_on_missing_deleted_and_stale(spark):
    rows = [
        (1, 0, 1, "set", b"a", b"1", 9),  # never there
        (2, 0, 1, "set", b"b", b"1", 0),
        (3, 0, 1, "set", b"b", b"2", 2),  # fresh
        (4, 0, 1, "set", b"b", b"3", 2),  # stale
        (5, 0, 1, "delete", b"b", None, 0),
        (6, 0, 1, "set", b"b", b"4", 5),  # a tombstone is absent
        (7, 0, 2, "set", b"b", b"5", 3),  # another namespace
    ]
    judged = fold.judged(ops_frame(spark, rows))
    got = {r["seq"]: (r["ok"], r["committed_seq"], r["cas_failed"]) for r in fold.responses(judged).collect()}
    assert got == {1: (False, 0, 0), 3: (True, 3, None), 4: (False, 3, 3), 6: (False, 0, 0), 7: (False, 0, 0)}
    status = {r["seq"]: (r["status"], r["rows_affected"]) for r in fold.outcomes(judged).collect()}
    assert status[4] == ("abort", 0) and status[5] == ("ok", 1)


def test_two_rivals_on_one_base(spark):
    rows = [(1, 0, 1, "set", b"k", b"0", 0), (2, 0, 1, "set", b"k", b"a", 1), (3, 0, 1, "set", b"k", b"b", 1)]
    got = {r["seq"]: (r["ok"], r["cas_failed"]) for r in fold.responses(fold.judged(ops_frame(spark, rows))).collect()}
    assert got == {2: (True, None), 3: (False, 2)}


def test_batch_takes_last_operation_of_a_key(spark):
    rows = [(1, 0, 1, "set", b"k1", b"x", 0), (1, 1, 1, "set", b"k2", b"y", 0), (1, 2, 1, "delete", b"k1", None, 0)]
    log = as_log(ops_frame(spark, rows))
    assert state_of(fold.fold(log, conditional=False)) == {(1, b"k2"): (1, b"y")}


def test_empty_value_is_no_tombstone_and_binary_order(spark):
    keys = [b"\x80", b"\x7f\x00", b"", b"\x7f", b"\xff\x00"]
    rows = [(i + 1, 0, 1, "set", k, b"", 0) for i, k in enumerate(keys) if k]
    v = fold.versions(fold.judged(ops_frame(spark, rows), conditional=False))
    assert [bytes(r["key"]) for r in reads.range_scan(v, None, None).collect()] == [b"\x7f", b"\x7f\x00", b"\x80", b"\xff\x00"]
    assert reads.get(v, b"\x7f").first()["value"] is None
    assert [bytes(r["value"]) for r in reads.range_scan(v, b"\x7f", b"\x80").collect()] == [b"", b""]
    assert reads.range_scan(v, b"", b"").collect() == []


def test_bad_requests(spark):
    rows = [(1, 0, 1, "set", b"", b"x", 0), (2, 0, 1, "set", b"k", None, 0), (3, 0, 1, "set", b"k", b"v", 1), (3, 1, 1, "set", b"j", b"v", 0), (4, 0, 1, "move", b"k", b"v", 0), (5, 0, 1, "set", b"k", b"v", 0)]
    bad = {(r["seq"], r["op_idx"]): r["reason"] for r in fold.check_requests(ops_frame(spark, rows)).collect()}
    assert bad == {(1, 0): "empty key", (2, 0): "set without value", (3, 0): "conditional operation in a batch", (4, 0): "unknown operation"}
    with pytest.raises(InvalidRequest):
        fold.require_valid(ops_frame(spark, rows))
    fold.require_valid(ops_frame(spark, rows[-1:]))


def test_empty_log(spark):
    judged = fold.judged(ops_frame(spark, []))
    assert fold.state(fold.versions(judged)).count() == 0 and fold.outcomes(judged).count() == 0


def test_too_many_subscribers_are_refused(spark):
    effects = cdc.effects(fold.judged(ops_frame(spark, random_ops(20, 1))))
    some = spark.range(256).selectExpr("id AS sub_id", "CAST(NULL AS INT) AS ns_filter", "0L AS cursor")
    assert cdc.deliveries(effects, some).select("sub_id").distinct().count() == 256
    with pytest.raises(TooManySubscribers):
        cdc.deliveries(effects, some.union(some.limit(1)))
