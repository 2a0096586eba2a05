"""The canonical schemas. Keys and values are opaque bytes; a tombstone is a flag, never an empty value."""

from __future__ import annotations

from pyspark.sql import types as T

OP = "struct<op_idx:int,ns:int,op:string,key:binary,value:binary,expected_seq:bigint>"
LOG = f"seq long, epoch long, kind string, partition int, client_id long, client_seq long, ops array<{OP}>"
OPS = "seq long, op_idx int, ns int, op string, key binary, value binary, expected_seq long"
OUTCOME = "seq long, status string, code string, rows_affected long"
VERSIONS = "ns int, key binary, seq long, value binary, is_tombstone boolean"
EFFECTS = "seq long, op_idx int, ns int, key binary, op string, before binary, after binary"

TXN_INTENT = "txn_intent"
KINDS = (TXN_INTENT, "config_change", "noop", "snapshot_marker", "epoch_decision", "commit_record")


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
