"""Messages as a stream: stateless processing, a content store, and sessions with a store of seen blocks.

`operators.sessions.process` takes a stream as it is.  Here are the two with state;
both keep hashes alone, and forget a session `timeout` after its last message.
"""

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators import dedup, sessions

STATE = "known array<string>"


def content_store(messages: DataFrame, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Each distinct block of a session once, as it first comes; JVM state alone.

    messages: conv_id, turn, text.  With a `time` column, a hash is kept for `delay`
    behind the latest time, else for good.
    """
    extra = [time] if time else []
    rows = messages.select("conv_id", "turn", *extra, F.posexplode(dedup.blocks(F.col("text"))).alias("block_idx", "block"))
    rows = rows.withColumn("sha", F.sha2(F.col("block").cast("binary"), 256))
    once = rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(["conv_id", "sha"]) if time else rows.dropDuplicates(["conv_id", "sha"])
    return once.select("conv_id", *extra, "sha", "block", dedup.handle(F.col("sha")).alias("handle"))


def store_sessions(messages: DataFrame, processor: sessions.Processor, timeout: str | None = None) -> DataFrame:
    """Every message processed against the blocks its session has shown, batch after batch.

    messages: conv_id, turn, raw.  Within a micro-batch a session's rows are taken by
    turn, so the trigger's size bounds what is sorted; across batches, as they come.
    `timeout` is a number of milliseconds of processing time.
    """
    if processor.dedup != "store":
        raise ValueError("a session of a stream needs a processor with dedup='store'")
    kind = messages.schema["conv_id"].dataType.simpleString()
    turn = messages.schema["turn"].dataType.simpleString()
    schema = f"conv_id {kind}, turn {turn}, raw string, sent string, {sessions.STATS_SCHEMA}"

    def step(key, frames: Iterator[pd.DataFrame], state):
        if state.hasTimedOut:
            state.remove()
            return
        known = dict.fromkeys(state.get[0], True) if state.exists else {}
        rows = pd.concat(list(frames)).sort_values(["turn", "raw"])
        made = []
        for at, raw in zip(rows["turn"], rows["raw"]):
            message = sessions.load(raw)
            sent, stats = processor.process(message, known)
            made.append((key[0], at, raw, raw if sent is message else json.dumps(sent, ensure_ascii=False), *stats.values()))
        state.update((list(known),))
        if timeout is not None:
            state.setTimeoutDuration(int(timeout))
        yield pd.DataFrame(made, columns=["conv_id", "turn", "raw", "sent", *(n.strip().split()[0] for n in sessions.STATS_SCHEMA.split(","))])

    waits = "NoTimeout" if timeout is None else "ProcessingTimeTimeout"
    return messages.select("conv_id", "turn", "raw").groupBy("conv_id").applyInPandasWithState(step, schema, STATE, "append", waits)
