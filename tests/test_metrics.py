import random

from tideline.functions import metrics


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "ns long")


def test_percentiles(spark):
    got = {r["p"]: r["upper"] for r in metrics.percentile(frame(spark, [500] * 50 + [100_000] * 50), [50, 99]).collect()}
    assert got == {50: 1000, 99: 128_000}
    assert metrics.percentile(frame(spark, []), [50]).first()["upper"] == 0


def test_buckets_against_a_loop(spark):
    r = random.Random(1)
    values = [r.choice([0, 1000, 1001, 16_384_000, 16_384_001, r.randrange(10**8)]) for _ in range(300)]
    want = [0] * 16
    for v in values:
        want[next((i for i, b in enumerate(metrics.BOUNDS) if v <= b), 15)] += 1
    assert [x["count"] for x in metrics.histogram(frame(spark, values)).orderBy("bucket").collect()] == want


def test_summary(spark):
    assert tuple(metrics.summary(frame(spark, [3, 4, 4])).first()) == (3, 11, 3, 4, 3)
    assert tuple(metrics.summary(frame(spark, [])).first()) == (0, 0, 0, 0, 0)
