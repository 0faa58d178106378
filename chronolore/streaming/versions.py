"""Facts as a stream: each closes the one before it of its key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CLOSURES = "key string, fact_id string, valid_from timestamp, valid_to timestamp, superseded_by string, late boolean"
TOLD = "key string, fact_id string, valid_from long, valid_to long, superseded_by string, late boolean"
STATE = "keys array<string>, fact_ids array<string>, moments array<long>"
# Fixed value: buckets of keys; a call of Python costs more than the few rows of a key, so it takes a bucket's.
BUCKETS = 4096


def close(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """In time order within a batch, for the keys of a bucket: a fact closes the open one of its key. One that comes later than it should is told as late and
    closes at once, at the start of what is open, without touching it; what was already told stays."""
    opened = {}
    if state.exists:
        keys, ids, moments = state.get
        opened = dict(zip(keys, zip(ids, moments, strict=True), strict=True))
    out = []
    rows = [r for part in parts for r in zip(part["at"], part["fact_id"], part["key"], strict=True)]
    for came, id_, key in sorted(rows, key=lambda r: (r[0], r[1] is None, r[1] or "")):
        if key not in opened:
            opened[key] = (id_, came)
            continue
        fact, at = opened[key]
        if came < at:
            out.append((key, id_, came, at, fact, True))
        else:
            out.append((key, fact, at, came, id_, False))
            opened[key] = (id_, came)
    state.update((list(opened), [f for f, _ in opened.values()], [int(at) for _, at in opened.values()]))
    if out:
        yield pd.DataFrame(out, columns=["key", "fact_id", "valid_from", "valid_to", "superseded_by", "late"])


def closures(stream: DataFrame) -> DataFrame:
    """stream: key, fact_id, at. State is one open fact per key, in the checkpoint of the query, by buckets of keys: a task holds a bucket's open facts and its
    rows of the batch. A fact without a moment is left out."""
    rows = stream.where("at IS NOT NULL").select(F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).alias("bucket"), "key", "fact_id", F.unix_micros(F.col("at").cast("timestamp")).alias("at"))
    told = rows.groupBy("bucket").applyInPandasWithState(close, TOLD, STATE, "append", GroupStateTimeout.NoTimeout)
    return told.select("key", "fact_id", F.timestamp_micros("valid_from").alias("valid_from"), F.timestamp_micros("valid_to").alias("valid_to"), "superseded_by", "late")


def windowed_counts(stream: DataFrame, at: str, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows per window and key; late rows are taken in up to the watermark."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window), key).agg(F.count(F.lit(1)).alias("n"))
