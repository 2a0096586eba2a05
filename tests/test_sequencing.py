import random

import pytest

from tideline.errors import SequenceGap
from tideline.operators import cdc, maintenance, sequencing


@pytest.mark.parametrize("seed", range(4))
def test_dense_and_idempotent(spark, seed):
    r = random.Random(seed)
    rows = [(a, r.randrange(4), r.randrange(12)) for a in sorted(r.sample(range(1000), r.randint(2, 80)))]
    df = spark.createDataFrame(rows, "arrival long, client_id long, client_seq long")
    got = sequencing.submit(df, next_seq=5, block=r.choice([10, 1 << 18])).collect()
    seen, want = {}, {}
    for a, c, s in rows:
        want[a] = (seen.setdefault((c, s), 5 + len(seen)), (c, s) in want.values() if False else None)
    assert {x["arrival"]: x["seq"] for x in got} == {a: w[0] for a, w in want.items()}
    assert sorted({x["seq"] for x in got}) == list(range(5, 5 + len(seen)))
    assert sum(not x["duplicate"] for x in got) == len(seen)
    assert all(x["partition"] == x["seq"] % 3 for x in sequencing.assign(df, 1, 3, block=16).collect())


def test_repeat_keeps_first_seq(spark):
    df = spark.createDataFrame([(0, 1, 1), (1, 1, 1), (2, 1, 2)], "arrival long, client_id long, client_seq long")
    assert [r["seq"] for r in sequencing.submit(df).orderBy("arrival").collect()] == [1, 1, 2]
    cache = sequencing.submit(df).select("client_id", "client_seq", "seq").distinct()
    assert [r["seq"] for r in sequencing.evict(cache, 2).collect()] == [2]


def test_merge_reads_in_order_once(spark):
    a = spark.createDataFrame([(1, "a1"), (3, "a3"), (5, "a5")], "seq long, payload string")
    b = spark.createDataFrame([(1, "b1"), (2, "b2"), (4, "b4")], "seq long, payload string")
    every = [(r["seq"], r["payload"]) for r in sequencing.merge([a, b]).collect()]
    assert every == [(1, "a1"), (2, "b2"), (3, "a3"), (4, "b4"), (5, "a5")]
    assert [r["seq"] for r in sequencing.merge([a, b], from_seq=2, most=2).collect()] == [2, 3]
    sequencing.require_dense(sequencing.merge([a, b]))
    with pytest.raises(SequenceGap):
        sequencing.require_dense(a)


def test_truncation_is_safe(spark):
    log = spark.createDataFrame([(i, i != 35) for i in range(1, 41)], "seq long, ok boolean")
    kept = lambda **k: maintenance.truncate_prefix(log, size=10, **k).agg({"seq": "min"}).first()[0]
    assert kept(before=30) == 1  # no snapshot, nothing is safe
    assert kept(before=30, snapshot_seq=25) == 21
    assert kept(before=30, snapshot_seq=25, min_cursor=12) == 11
    assert maintenance.valid_prefix(log).count() == 34
    assert maintenance.valid_prefix(log.filter("ok")).count() == 39
    assert maintenance.truncate_suffix(log, 5).count() == 4
    assert spark.range(1).select(maintenance.checksum(*[__import__("pyspark.sql.functions", fromlist=["lit"]).lit("123456789")])).first()[0] == 0xCBF43926


def test_cursors(spark):
    subs = spark.createDataFrame([(1, None, 3), (2, 1, 9)], "sub_id int, ns_filter int, cursor long")
    assert cdc.min_cursor(subs).first()[0] == 3
    assert cdc.min_cursor(cdc.acknowledge(subs, 1, 20)).first()[0] == 9
    assert cdc.min_cursor(cdc.acknowledge(subs, 2, 1)).first()[0] == 3
    assert cdc.min_cursor(subs.filter("sub_id > 5")).first()[0] == 0
