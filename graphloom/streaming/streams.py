"""Structured Streaming: keyed completion with state, and windowed counts with a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DONE = "key string, parts int, status string"


def completed(parts: DataFrame, key: str, index: str, total: str, patience_ms: int | None = None) -> DataFrame:
    """(key, parts, status): a key is emitted once all of its ``total`` parts came (complete), or, when ``patience_ms``
    is given and no part came for so many milliseconds of processing time, with what there is (partial). A part that comes again counts once; parts without
    key, index or total are ignored.

    State is a bit set of the parts that came, so its size follows the number of open parts and not their content.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, want, closed = state.get if state.exists else (b"", 0, False)
        bits = int.from_bytes(seen, "little")
        if state.hasTimedOut:
            state.remove()
            if not closed:
                yield pd.DataFrame({"key": [k[0]], "parts": [bits.bit_count()], "status": ["partial"]})
            return
        for part in batches:
            for i, t in zip(part["i"], part["t"]):
                want = max(want, int(t))
                bits |= 1 << int(i)
        if not closed and want and bits & ((1 << want) - 1) == (1 << want) - 1:
            closed = True
            yield pd.DataFrame({"key": [k[0]], "parts": [want], "status": ["complete"]})
        state.update((bits.to_bytes((bits.bit_length() + 7) // 8, "little"), want, closed))
        if patience_ms is not None:
            state.setTimeoutDuration(patience_ms)

    rows = parts.select(F.col(key).alias("k"), F.col(index).alias("i"), F.col(total).alias("t")).where("k is not null and i >= 0 and t is not null")
    return rows.groupBy("k").applyInPandasWithState(step, DONE, "seen binary, want int, closed boolean", "append", GroupStateTimeout.NoTimeout if patience_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def windowed(events: DataFrame, at: str, kind: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window of event time and kind; events later than ``late`` behind the watermark are dropped."""
    return (
        events.withWatermark(at, late)
        .groupBy(F.window(at, width), kind)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        .select(F.col("window.start").alias("start"), kind, "n", F.round("total", 6).alias("total"))
    )
