"""Conversation turns as tables: where each request goes, what comes back, what the memory keeps."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import inventory as inv
from .engine import answer_sources


def routed(requests: DataFrame, decided: DataFrame | None = None) -> DataFrame:
    """(query_id, query_text, intent): by wording; what wording leaves open by ``decided`` (query_id, intent, query), else 'rag'."""
    known = requests.withColumn("fast", tx.intent(F.col("query_text")))
    if decided is None:
        decided = requests.limit(0).select("query_id", F.lit("").alias("intent"), F.lit("").alias("query"))
    both = known.join(decided.select("query_id", F.col("intent").alias("asked"), F.col("query").alias("refined")), "query_id", "left")
    open_ = F.col("fast") == "ask"
    valid = F.when(F.lower("asked").isin("chat", "list_docs", "rag"), F.lower("asked"))
    text = F.when(open_ & (F.trim(F.coalesce("refined", F.lit(""))) != ""), F.col("refined")).otherwise(F.col("query_text"))
    return both.select("query_id", text.alias("query_text"), F.when(open_, F.coalesce(valid, F.lit("rag"))).otherwise(F.col("fast")).alias("intent"))


def replies(requests: DataFrame, tables: dict[str, DataFrame], embed: Callable, decided: DataFrame | None = None) -> dict[str, DataFrame]:
    """Sources of the 'rag' requests, the inventory for 'list_docs', the ids of those that are answered by talk.

    A 'rag' request that finds nothing is answered by talk as well.
    """
    route = routed(requests, decided)
    sources = answer_sources(route.filter("intent = 'rag'").select("query_id", "query_text"), tables, embed)
    found = sources.select("query_id").distinct()
    talk = route.join(found, "query_id", "left_anti").filter("intent != 'list_docs'").select("query_id", "query_text")
    listing = inv.counts(tables["rag_documents"], tables["document_paragraphs"])
    return {"sources": sources, "inventory": listing, "talk": talk, "route": route}


def remembered(messages: DataFrame, turns: DataFrame) -> DataFrame:
    """Messages with the turns (session_id, query_text, answer) behind them, numbered on from the last of each session."""
    last = messages.groupBy("session_id").agg(F.max("no").alias("last"))
    both = turns.join(last, "session_id", "left").withColumn("next", F.coalesce("last", F.lit(0)) + 1)
    kind = messages.schema["no"].dataType
    asked = both.select("session_id", F.col("next").cast(kind).alias("no"), F.lit("user").alias("role"), F.col("query_text").alias("content"))
    said = both.select("session_id", (F.col("next") + 1).cast(kind).alias("no"), F.lit("assistant").alias("role"), F.col("answer").alias("content"))
    return messages.select("session_id", "no", "role", "content").unionByName(asked).unionByName(said.filter("content IS NOT NULL"))


def within(spark: SparkSession, seconds: float, action: Callable):
    """Runs an action under a time budget; its jobs are cancelled when it is used up, which raises TimeoutError."""
    group, over = f"budget-{uuid.uuid4()}", threading.Event()

    def stop() -> None:
        over.set()
        spark.sparkContext.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    spark.sparkContext.setJobGroup(group, "within a time budget", interruptOnCancel=True)
    timer.start()
    try:
        return action()
    except Exception as e:
        if over.is_set():
            raise TimeoutError(f"more than {seconds} s") from e
        raise
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
