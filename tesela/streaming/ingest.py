"""Streams: files that arrive become chunks; messages that arrive become kept sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.chunk import chunk_documents, ingest_tables
from ..sources.files import append


def stream_documents(spark: SparkSession, folder: str, schema: str, root: str, checkpoint: str, overlap: int = 80):
    """Chunks documents (parquet rows with id, title, content, mime_type) that arrive in ``folder`` and appends the tables to ``root``.

    Ids are hashes of natural keys: a micro-batch that is repeated after a failure writes the same rows, and readers make them
    unique. Returns the running query.
    """
    arriving = spark.readStream.schema(schema).parquet(folder)

    def store(batch: DataFrame, _: int) -> None:
        pieces = chunk_documents(batch, overlap=overlap).persist()
        append(ingest_tables(batch, pieces), root)
        pieces.unpersist()

    return arriving.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_sessions(messages: DataFrame, max_turns: int = 10) -> DataFrame:
    """(session_id, kept, dropped): keyed state of a message stream. A session with more than 2 * max_turns messages gives up its
    older half; the state holds the messages that stay, so it is bounded for each session."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, dropped = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        for pdf in parts:
            for text in pdf.sort_values("no")["content"]:
                kept.append(text)
                if len(kept) > 2 * max_turns:
                    half = len(kept) // 2
                    kept, dropped = kept[half:], dropped + half
        state.update((kept, dropped))
        yield pd.DataFrame({"session_id": [key[0]], "kept": [len(kept)], "dropped": [dropped]})

    return messages.groupBy("session_id").applyInPandasWithState(step, "session_id string, kept int, dropped int", "kept array<string>, dropped int", "update", GroupStateTimeout.NoTimeout)


def event_windows(events: DataFrame, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total): counts in tumbling windows with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
