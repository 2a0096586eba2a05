from model import fold as model_fold
from model import ops_frame, random_ops

from tideline.operators import cdc, fold
from tideline.streaming import fold_stream


def test_stream_stops_and_goes_on(spark, tmp_path):
    rows, source, out, mark = random_ops(240, 11), str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    for part in (rows[:120], rows[120:]):
        for half in (part[:60], part[60:]):
            ops_frame(spark, half).coalesce(1).write.mode("append").parquet(source)
        query = fold_stream.append_effects(fold_stream.fold_stream(fold_stream.read_ops(spark, source, 1)), out, mark)
        query.awaitTermination()
    found = spark.read.schema(fold_stream.OUT).parquet(f"{out}/batch=*")
    ok, effects, _ = model_fold(rows)
    assert {r["seq"]: r["ok"] for r in found.collect()} == ok
    events = {r["seq"]: len(r["effects"]) for r in fold_stream.transactions(found).collect()}
    batch = {r["seq"]: len(r["effects"]) for r in cdc.events(cdc.effects(fold.judged(ops_frame(spark, rows)))).collect()}
    assert events == batch and sum(events.values()) == len(effects)
