"""The log as a stream: batches of writes get their sequence numbers at commit, readers keep the newest row of each key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import order
from ..sources.store import Store


def ingest(writes: DataFrame, store: Store, checkpoint: str, name: str = "writes") -> StreamingQuery:
    """Applies a stream of writes(op, k, v, order_key) to a store: a micro-batch is one atomic batch, in order of
    order_key, whose values differ in a batch.  A batch that was committed before a restart isn't applied again: its
    number is among the store's marks, under the stream's name."""
    mark = f"stream:{name}"

    def apply(batch: DataFrame, number: int) -> None:
        if store.state()["marks"].get(mark, -1) >= number:
            return
        batch.persist()
        try:
            rows = order.numbered(order.celled(batch, "order_key"), [F.col("order_key")])
            ordinal = (F.col("position") - 1).cast("long").alias("ordinal")
            store.write(rows.select(ordinal, F.col("op").cast("int").alias("op"), F.col("k").cast("binary").alias("k"), F.col("v").cast("binary").alias("v")), **{mark: number})
        finally:
            batch.unpersist()

    return writes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(log: DataFrame) -> DataFrame:
    """The newest row of each key of a streamed log(k, seq, op, v), in update mode: state is one row a key, and rows that
    come late are known by their sequence numbers.  Keys and values may be of any type."""
    key, value = log.schema["k"].dataType, log.schema["v"].dataType
    held = T.StructType([T.StructField("seq", T.LongType()), T.StructField("op", T.IntegerType()), T.StructField("v", value)])

    def newest(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else (-1, 0, None)
        before = best[0]
        for part in parts:
            row = part.loc[part["seq"].idxmax()]
            if row["seq"] > best[0]:
                v = row["v"]
                best = (int(row["seq"]), int(row["op"]), None if v is None or v != v else v.item() if hasattr(v, "item") else v)
        if best[0] > before:
            state.update(best)
            yield pd.DataFrame({"k": [group[0]], "seq": [best[0]], "op": [best[1]], "v": [best[2]]})

    return log.groupBy("k").applyInPandasWithState(newest, T.StructType([T.StructField("k", key), *held.fields]), held, "update", GroupStateTimeout.NoTimeout)
