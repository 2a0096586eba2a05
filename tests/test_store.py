from model import ops_frame, random_ops

from tideline.operators import fold, maintenance
from tideline.sources import store
from tideline.sources.fixtures import as_log


def rows_of(df):
    return sorted((r["ns"], bytes(r["key"]), r["seq"], r["value"] and bytes(r["value"])) for r in df.collect())


def test_snapshot_and_tail_equal_the_whole_fold(spark, tmp_path):
    v = fold.versions(fold.judged(ops_frame(spark, random_ops(200, 3, cas=True)))).cache()
    root = str(tmp_path / "snaps")
    assert rows_of(fold.state(store.recover(spark, root, v))) == rows_of(fold.state(v))
    for s in (50, 120):
        store.snapshot(v, root, s)
    (tmp_path / "snaps/0/00000000000000000150").mkdir()  # one that never got its manifest
    assert store.snapshots(spark, root) == [50, 120]
    assert rows_of(fold.state(store.restore(spark, root, 50))) == rows_of(fold.state(v, 50))
    assert rows_of(fold.state(store.recover(spark, root, v))) == rows_of(fold.state(v))


def test_compaction_keeps_reads(spark, tmp_path):
    rows = [(1, 0, 1, "set", b"a", b"1", 0), (1, 1, 1, "set", b"b", b"1", 0), (2, 0, 1, "delete", b"b", None, 0), (3, 0, 1, "set", b"c", b"", 0), (4, 0, 1, "set", b"a", b"4", 0)]
    v = fold.versions(fold.judged(ops_frame(spark, rows), conditional=False))
    store.write_versions(v, str(tmp_path / "v"), files=2)
    store.compact_store(spark, str(tmp_path / "v"), str(tmp_path / "c"))
    c = store.read_versions(spark, str(tmp_path / "c"))
    assert rows_of(fold.state(c)) == [(1, b"a", 4, b"4"), (1, b"c", 3, b"")]
    assert c.filter("is_tombstone").count() == 1 and maintenance.drop_tombstones(c).count() == 2
    kept = maintenance.compact(v, retain_from=2)
    for at in (2, 3, 4):
        assert rows_of(fold.state(kept, at)) == rows_of(fold.state(v, at))


def test_log_round_trip(spark, tmp_path):
    log = as_log(ops_frame(spark, random_ops(50, 8)))
    store.write_log(log, str(tmp_path / "log"), segment=10)
    back = store.read_log(spark, str(tmp_path / "log"))
    assert sorted(map(str, back.collect())) == sorted(map(str, log.collect()))
    assert rows_of(fold.fold(back)) == rows_of(fold.fold(log))


def test_expiry_keeps_the_newest(spark, tmp_path):
    v = fold.versions(fold.judged(ops_frame(spark, random_ops(60, 7, cas=False)), conditional=False))
    for seq in (10, 20, 30):
        store.snapshot(v, str(tmp_path / "s"), seq)
    assert store.expire(spark, str(tmp_path / "s"), 2) == [10] and store.snapshots(spark, str(tmp_path / "s")) == [20, 30]
    assert store.expire(spark, str(tmp_path / "s"), 0) == [20] and store.expire(spark, str(tmp_path / "none"), 1) == []
    assert store.snapshot_due(10, 20, 10) and not store.snapshot_due(10, 19, 10) and not store.snapshot_due(0, 99, 0)


def test_recovery_folds_the_tail_upon_the_snapshot(spark, tmp_path):
    log = as_log(ops_frame(spark, random_ops(300, 8, cas=True)))
    whole, root = fold.versions(fold.judged(fold.operations(log))), str(tmp_path / "s")
    assert rows_of(fold.state(store.recover_from_log(spark, root, log))) == rows_of(fold.state(whole))
    store.snapshot(whole, root, 140)
    tail = log.filter("seq > 140")
    assert rows_of(fold.state(store.recover_from_log(spark, root, tail))) == rows_of(fold.state(whole))
