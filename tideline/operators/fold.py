"""The fold: ordered operations to outcomes, versions and state.

Nothing here orders a key in one task. The latest version is a maximum (combined before the shuffle), and conditional
sets are settled by links: a conditional set can only succeed if it is the first one to expect its predecessor, with no
unconditional operation between them, and if its predecessor succeeded. That is a forest of chains, solved by
pointer doubling in logarithmically many joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidRequest
from ..functions.keys import visible
from ..functions.ordered import BLOCK, carry
from ..schemas import TXN_INTENT
from ..session import stored

KEY = ["ns", "key"]


def operations(log: DataFrame) -> DataFrame:
    """OPS of LOG: one row per operation; entries of other kinds have none."""
    intents = log.filter(F.col("kind") == TXN_INTENT)
    return intents.select("seq", F.inline("ops")).select("seq", "op_idx", "ns", "op", "key", "value", "expected_seq")


def coalesce_ops(ops: DataFrame) -> DataFrame:
    """Of operations on one key in one transaction the last."""
    rest = [c for c in ops.columns if c not in ("seq", "op_idx", *KEY)]
    last = ops.groupBy("seq", *KEY).agg(F.max(F.struct("op_idx", *rest)).alias("last"))
    return last.select("seq", "last.op_idx", *KEY, *[f"last.{c}" for c in rest])


def check_requests(ops: DataFrame) -> DataFrame:
    """The operations that must not be written, with a reason: an empty key, an unknown operation, a set without
    value, or a conditional set in a batch."""
    batch = ops.groupBy("seq").agg(F.count("*").alias("n"))
    reason = (
        F.when(F.octet_length("key") == 0, "empty key")
        .when(~F.col("op").isin("set", "delete"), "unknown operation")
        .when((F.col("op") == "set") & F.col("value").isNull(), "set without value")
        .when((F.col("expected_seq") > 0) & ((F.col("n") > 1) | (F.col("op") != "set")), "conditional operation in a batch")
    )
    return ops.join(batch, "seq").withColumn("reason", reason).filter("reason IS NOT NULL").select("seq", "op_idx", *KEY, "op", "reason")


def require_valid(ops: DataFrame) -> None:
    bad = check_requests(ops).take(1)
    if bad:
        raise InvalidRequest(f"{bad[0]['reason']} at seq {bad[0]['seq']}")


def conditional_verdicts(ops: DataFrame, block: int = BLOCK) -> DataFrame:
    """seq, ns, key, ok for each conditional set in coalesced ops."""
    free = F.col("expected_seq") == 0
    rooted = carry(ops.select("seq", *KEY, "op", "expected_seq"), KEY, "seq", [], F.when(free, F.struct(F.col("seq").alias("at"), "op")), "root", block)
    asked = rooted.filter(~free).select("seq", *KEY, F.col("expected_seq").alias("want"), F.col("root.at").alias("root_seq"), F.col("root.op").alias("root_op"))
    asked = stored(asked, "conditional")
    able = asked.filter((F.col("root_op") == "set") & (F.col("want") >= F.col("root_seq")) & (F.col("want") < F.col("seq")))
    first = able.groupBy(*KEY, "want").agg(F.min(F.struct("seq", (F.col("want") == F.col("root_seq")).alias("direct"))).alias("f"))
    links = stored(first.select(*KEY, "f.seq", F.col("want").alias("back"), F.when(F.col("f.direct"), True).alias("ok")), "links")
    while True:
        at = links.select(*KEY, F.col("seq").alias("back"), F.col("back").alias("further"), F.col("ok").alias("known"), F.lit(True).alias("there"))
        verdict = F.when(F.col("ok").isNotNull(), F.col("ok")).when(F.col("there").isNull(), F.lit(False)).otherwise(F.col("known"))
        ahead = F.when(F.col("ok").isNull() & F.col("there") & F.col("known").isNull(), F.col("further")).otherwise(F.col("back"))
        links = stored(links.join(at, [*KEY, "back"], "left").select(*KEY, "seq", ahead.alias("back"), verdict.alias("ok")), "links")
        if not links.filter("ok IS NULL").limit(1).count():
            break
    won = links.filter("ok").select(*KEY, "seq", "ok")
    return asked.select("seq", *KEY).join(won, [*KEY, "seq"], "left").select("seq", *KEY, F.coalesce("ok", F.lit(False)).alias("ok"))


def judged(ops: DataFrame, conditional: bool = True, initial: DataFrame | None = None) -> DataFrame:
    """Coalesced ops with ok: whether their transaction is applied. Pass conditional=False for a log without
    conditional sets, which needs no verdicts. initial is the state(ns, key, value, seq) that the first of ops meets: with it
    the tail of a log is judged without the log before."""
    one = coalesce_ops(ops)
    if not conditional:
        return one.withColumn("ok", F.lit(True))
    one = stored(one, "operations")
    met = one
    if initial is not None:
        given = initial.join(one.select(*KEY).distinct(), KEY, "left_semi").select("seq", F.lit(0).alias("op_idx"), *KEY, F.lit("set").alias("op"), "value", F.lit(0).cast("long").alias("expected_seq"))
        met = one.unionByName(given)
    failed = conditional_verdicts(met).filter("NOT ok").select("seq").distinct().withColumn("failed", F.lit(True))
    return one.join(failed, "seq", "left").withColumn("ok", F.col("failed").isNull()).drop("failed")


def outcomes(judged_ops: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """OUTCOME of each transaction; with the log, entries without operations are no-ops and broken ones abort."""
    done = judged_ops.groupBy("seq").agg(F.bool_and("ok").alias("ok"), F.count("*").alias("n"))
    if log is not None:
        kinds = ["seq", "kind"] + (["payload_ok"] if "payload_ok" in log.columns else [])
        done = log.select(*kinds).join(done, "seq", "left")
    else:
        done = done.withColumn("kind", F.lit(TXN_INTENT))
    broken = ~F.col("payload_ok") if "payload_ok" in done.columns else F.lit(False)
    status = F.when(F.col("kind") != TXN_INTENT, "noop").when(broken | ~F.coalesce("ok", F.lit(True)), "abort").otherwise("ok")
    code = F.when(broken & (F.col("kind") == TXN_INTENT), "bad_payload").when(status == "abort", "constraint_violation")
    return done.select("seq", status.alias("status"), code.alias("code"), F.when(status == "ok", F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("rows_affected"))


def versions(judged_ops: DataFrame) -> DataFrame:
    """VERSIONS: what applied operations wrote."""
    tomb = F.col("op") == "delete"
    return judged_ops.filter("ok").select(*KEY, "seq", F.when(~tomb, F.col("value")).alias("value"), tomb.alias("is_tombstone"))


def newest(versions_: DataFrame, at_seq: int | None = None) -> DataFrame:
    """The newest version of each key at at_seq, tombstones included."""
    top = versions_.filter(visible(F.col("seq"), at_seq)).groupBy(*KEY).agg(F.max(F.struct("seq", "is_tombstone", "value")).alias("v"))
    return top.select(*KEY, "v.seq", "v.value", "v.is_tombstone")


def state(versions_: DataFrame, at_seq: int | None = None) -> DataFrame:
    """Live rows: tombstones go after the newest version is found, or deleted keys would come back."""
    return newest(versions_, at_seq).filter("NOT is_tombstone").drop("is_tombstone")


def fold(log: DataFrame, at_seq: int | None = None, conditional: bool = True) -> DataFrame:
    """State of a LOG at at_seq."""
    return state(versions(judged(operations(log.filter(visible(F.col("seq"), at_seq))), conditional)))


def responses(judged_ops: DataFrame, block: int = BLOCK) -> DataFrame:
    """What each conditional set answers: its own seq, or on failure the key's current one (0: none) in cas_failed."""
    live = F.when(F.col("ok"), F.struct(F.when(F.col("op") == "set", F.col("seq")).alias("at")))
    now = carry(judged_ops, KEY, "seq", [], live, "current", block).filter(F.col("expected_seq") > 0)
    current: Column = F.coalesce("current.at", F.lit(0).cast("long"))
    return now.select("seq", *KEY, "ok", F.when(F.col("ok"), F.col("seq")).otherwise(current).alias("committed_seq"), F.when(~F.col("ok"), current).alias("cas_failed"))
