"""Continuous ingest: exact deduplication across micro-batches, durable by checkpoint."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def ingest(requests: DataFrame, store, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Put each micro-batch of requests into a store; all that is there is taken, unless ``every`` names an interval.

    The store deduplicates against all it holds, so a batch that is replayed
    after a failure stores nothing twice.
    """
    out = requests.writeStream.foreachBatch(lambda batch, _: store.put(batch) and None).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def distinct_contents(requests: DataFrame) -> DataFrame:
    """The first of each content ever seen, by state kept for good."""
    return requests.withColumn("hash", F.sha2("content", 256)).dropDuplicates(["hash"])


def last_calls(calls: DataFrame, most: int = 100) -> DataFrame:
    """(channel, seq): the newest ``most`` sequence numbers of each channel, by state; emitted when they change."""

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for batch in batches:
            held = sorted({*held, *batch["seq"].tolist()})[-most:]
        state.update((held,))
        yield pd.DataFrame({"channel": [key[0]], "seqs": [held]})

    return calls.groupBy("channel").applyInPandasWithState(keep, "channel string, seqs array<bigint>", "held array<bigint>", "update", GroupStateTimeout.NoTimeout)


def token_buckets(requests: DataFrame, rate: float, burst: float) -> DataFrame:
    """(key, at, allowed) for requests (key, at in seconds): a bucket of tokens for each key, refilled at ``rate``.

    What a trigger brings for a key is poured in order of time, whatever order
    it comes in; of it, only the times are held, eight bytes each.
    """

    def pour(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (burst, None)
        times = np.sort(np.concatenate([batch["at"].to_numpy(float) for batch in batches]))
        allowed = np.zeros(len(times), dtype=bool)
        for i, at in enumerate(times):
            tokens = min(burst, tokens + (max(0.0, at - last) * rate if last is not None else 0.0))
            last = at
            allowed[i] = tokens >= 1
            tokens -= allowed[i]
        for i in range(0, len(times), 10_000):
            yield pd.DataFrame({"key": key[0], "at": times[i : i + 10_000], "allowed": allowed[i : i + 10_000]})
        state.update((float(tokens), float(last)))

    return requests.groupBy("key").applyInPandasWithState(pour, "key string, at double, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)
