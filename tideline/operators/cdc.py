"""Change data capture: effects with before and after images, per transaction and subscriber."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import TooManySubscribers
from ..functions.ordered import BLOCK, carry
from .fold import KEY

#: Fixed value: as many can subscribe, so they are always few enough to be broadcast.
MOST_SUBSCRIBERS = 256


def effects(judged_ops: DataFrame, block: int = BLOCK) -> DataFrame:
    """EFFECTS of applied operations. The before image is the live value just before; a delete of an absent key has
    an effect with two nulls. `is_insert` tells whether there was no live value."""
    applied = judged_ops.filter("ok").select("seq", "op_idx", *KEY, "op", "value")
    now = F.struct(F.when(F.col("op") == "set", F.col("value")).alias("value"))
    seen = carry(applied, KEY, "seq", [], now, "old", block)
    op = F.when(F.col("op") == "delete", "delete").otherwise("update")
    after = F.when(F.col("op") == "set", F.col("value"))
    return seen.select("seq", "op_idx", *KEY, op.alias("op"), F.col("old.value").alias("before"), after.alias("after"), ((F.col("op") == "set") & F.col("old.value").isNull()).alias("is_insert"))


def filtered(effects_: DataFrame, ns: int | None = None, from_seq: int = 0) -> DataFrame:
    """What a subscription to a namespace (None: all) sees after its cursor."""
    seen = effects_.filter(F.col("seq") > from_seq)
    return seen if ns is None else seen.filter(F.col("ns") == ns)


def events(effects_: DataFrame) -> DataFrame:
    """One event per transaction, effects in operation order; transactions without effects have none."""
    each = F.struct("op_idx", *KEY, "op", "before", "after")
    return effects_.groupBy("seq").agg(F.array_sort(F.collect_list(each)).alias("effects"))


def deliveries(effects_: DataFrame, subscribers: DataFrame) -> DataFrame:
    """sub_id and seq of each event that subscribers(sub_id, ns_filter, cursor) have yet to see, with its effects' number.
    More than MOST_SUBSCRIBERS are refused."""
    if subscribers.limit(MOST_SUBSCRIBERS + 1).count() > MOST_SUBSCRIBERS:
        raise TooManySubscribers(f"more than {MOST_SUBSCRIBERS}")
    by_txn = effects_.groupBy("seq", "ns").agg(F.count("*").alias("n"))
    s = F.broadcast(subscribers)
    hit = by_txn.join(s, (F.col("ns_filter").isNull() | (F.col("ns") == F.col("ns_filter"))) & (F.col("seq") > F.col("cursor")))
    return hit.groupBy("sub_id", "seq").agg(F.sum("n").alias("effects"))


def unsubscribe(subscribers: DataFrame, sub_id: int) -> DataFrame:
    """Subscribers without one; an unknown id changes nothing."""
    return subscribers.filter(F.col("sub_id") != sub_id)


def next_events(effects_: DataFrame, subscriber: DataFrame, most: int) -> DataFrame:
    """The first `most` events, by seq, that one subscriber(sub_id, ns_filter, cursor) has yet to see, with their effects' number."""
    return deliveries(effects_, subscriber).orderBy("seq").limit(most)


def acknowledge(subscribers: DataFrame, sub_id: int, seq: int) -> DataFrame:
    """Subscribers after one has acknowledged up to seq; cursors never go back."""
    return subscribers.withColumn("cursor", F.when(F.col("sub_id") == sub_id, F.greatest("cursor", F.lit(seq))).otherwise(F.col("cursor")))


def min_cursor(subscribers: DataFrame) -> DataFrame:
    """The seq up to which every subscriber has seen all; 0 without subscribers."""
    return subscribers.agg(F.coalesce(F.min("cursor"), F.lit(0)).cast("long").alias("min_cursor"))
