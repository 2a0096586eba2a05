from model import ops_frame, random_ops
from model import fold as model_fold

from tideline.operators import fold, reads


def versions(spark, rows):
    return fold.versions(fold.judged(ops_frame(spark, rows), conditional=False))


def plain(n, seed):
    return [r for r in random_ops(n, seed, cas=False)] + [(n + 1, 0, 1, "delete", b"k3", None, 0)]


def test_reads_at_every_seq(spark):
    rows = plain(60, 4)
    v = versions(spark, rows).cache()
    asks = [(s, 1, f"k{s % 14}".encode(), s) for s in range(0, 62)]
    got = {r["req_idx"]: (r["found"], r["value"] and bytes(r["value"]), r["committed_seq"]) for block in (1 << 18, 9) for r in reads.multi_get_as_of(v, spark.createDataFrame(asks, "req_idx long, ns int, key binary, at_seq long"), block).collect()}
    for i, ns, key, at in asks:
        seq, value = model_fold([r for r in rows if r[0] <= at])[2].get((ns, key), (0, None))
        assert got[i] == (value is not None, value, seq)
    assert reads.get(v, "k3").first()["committed_seq"] == 0
    assert reads.get(v, "k1", at_seq=0).first()["value"] is None


def test_natural_order_and_limit(spark):
    rows = [(i + 1, 0, 1, "set", k, b"v", 0) for i, k in enumerate([b"bench:1", b"bench:2", b"bench:10", b"bench:100", b"other"])]
    v = versions(spark, rows)
    assert [bytes(r["key"]) for r in reads.range_scan(v, "bench:", "bench;").collect()] == [b"bench:1", b"bench:10", b"bench:100", b"bench:2"]
    assert reads.range_scan(v, "bench:", "bench;", limit=2).count() == 2


def test_range_batch_both_ways(spark, monkeypatch):
    v = versions(spark, plain(80, 5))
    asks = spark.createDataFrame([(1, 1, b"k", b"l", 0), (2, 1, b"k1", b"k3", 2), (3, 1, b"k5", b"k5", 0), (4, 2, b"a", b"z", 0), (5, 1, b"k0", b"k2", 1)], "req_idx long, ns int, start binary, end binary, lim int")
    small = sorted(map(tuple, reads.range_batch(v, asks).collect()))
    monkeypatch.setattr(reads, "BROADCAST_RANGES", 0)
    large = sorted(map(tuple, reads.range_batch(v, asks).select(*reads.range_batch(v, asks).columns).collect()))
    assert {r[0] for r in small} == {1, 2, 5} and sorted(map(str, small)) == sorted(str(r) for r in large)


def test_scatter_scan_and_multi_get(spark):
    v = versions(spark, plain(80, 6))
    want = [tuple(r) for r in fold.state(v).orderBy("ns", "key").collect()]
    assert [tuple(r) for r in reads.scatter_scan(v, 3).collect()] == want
    asks = spark.createDataFrame([(0, 1, b"k1"), (1, 1, b"none")], "req_idx long, ns int, key binary")
    got = {r["req_idx"]: r["found"] for r in reads.multi_get(v, asks).collect()}
    assert got == {0: True, 1: False}


def test_filters_reach_the_scan(spark, tmp_path):
    from tideline.sources import store

    store.write_versions(versions(spark, plain(50, 7)), str(tmp_path / "v"), files=2)
    plan = reads.range_scan(store.read_versions(spark, str(tmp_path / "v")), "k1", "k2", at_seq=9)._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(key," in plan and "PartitionFilters: [" in plan.split("PushedFilters")[0] and "(ns#" in plan.split("PartitionFilters")[1]
