"""The fold as a stream: a log that grows by files in seq order, folded micro-batch by micro-batch.

Each key's state is its live version; within a batch a key's operations are put in seq order, so the order in which
rows reach the operator does not matter. A transaction must lie within one micro-batch.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..schemas import OPS, struct

OUT = "seq long, op_idx int, ns int, key binary, op string, ok boolean, before binary, after binary"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class KeyFold(StatefulProcessor):
    """Settles one key's operations against its live version."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getValueState("live", "seq long, value binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ns, raw = int(key[0]), bytes(key[1])
        old = self.live.get() if self.live.exists() else None
        seq, value = (int(old[0]), bytes(old[1])) if old else (None, None)
        ops = pd.concat(list(rows)).sort_values(["seq", "op_idx"])
        ops = ops[~ops.duplicated("seq", keep="last")]
        out = []
        for r in ops.itertuples(index=False):
            ok = r.expected_seq == 0 or r.expected_seq == seq
            new = None if r.op == "delete" or r.value is None else bytes(r.value)
            out.append((int(r.seq), int(r.op_idx), ns, raw, "delete" if r.op == "delete" else "update", ok, value if ok else None, new if ok else None))
            if ok:
                seq, value = (None, None) if r.op == "delete" else (int(r.seq), new)
        if seq is None:
            self.live.clear()
        else:
            self.live.update((seq, value))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in OUT.split(", ")])

    def close(self) -> None:
        pass


def read_ops(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of OPS from Parquet files."""
    reader = spark.readStream.schema(struct(OPS))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def fold_stream(ops: DataFrame) -> DataFrame:
    """Verdict and effect of each operation; needs the RocksDB state store."""
    # the streaming runner starts workers of its own, which get no shipped files
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    ops.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return ops.groupBy("ns", "key").transformWithStateInPandas(KeyFold(), outputStructType=struct(OUT), outputMode="Append", timeMode="None")


def append_effects(stream: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Starts a query that writes each micro-batch's verdicts and effects to its own folder. A batch that is tried again
    overwrites its folder, so results are exactly once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def transactions(effects: DataFrame) -> DataFrame:
    """Whole-transaction events from applied effects of a batch or a store of batches."""
    each = F.struct("op_idx", "ns", "key", "op", "before", "after")
    return effects.filter("ok").groupBy("seq").agg(F.array_sort(F.collect_list(each)).alias("effects"))
