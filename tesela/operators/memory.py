"""Conversation memory: histories, roll-over into summaries, texts. Messages are rows (session_id, no, role, content)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def opened(messages: DataFrame, sessions: DataFrame, prompt: str | None = None) -> DataFrame:
    """Messages of the sessions, a system message in front of those that are new and have none."""
    if prompt is None:
        return messages
    fresh = sessions.select("session_id").distinct().join(messages.select("session_id").distinct(), "session_id", "left_anti")
    return messages.unionByName(fresh.select("session_id", F.lit(-1).cast(messages.schema["no"].dataType).alias("no"), F.lit("system").alias("role"), F.lit(prompt).alias("content")))


def rolled(messages: DataFrame, max_turns: int = 10, summarize: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, summaries): sessions with more than 2 * max_turns messages besides system ones give up the older half.

    kept: the messages that stay; summaries (session_id, summary): the text of the older half, through ``summarize`` if given.
    """
    w = Window.partitionBy("session_id").orderBy("no")
    talk = messages.filter("role != 'system'").withColumn("place", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("session_id")))
    old = (F.col("n") > 2 * max_turns) & (F.col("place") <= F.floor(F.col("n") / 2))
    kept = messages.filter("role = 'system'").unionByName(talk.filter(~old).select(messages.columns))
    past = talk.filter(old).groupBy("session_id").agg(history_column().alias("text"))
    return kept, past.select("session_id", (summarize(F.col("text")) if summarize else F.col("text")).alias("summary"))


def history_column(order: str = "no") -> Column:
    """Aggregate: 'ROLE: content' in order, a line each."""
    line = F.concat(F.upper("role"), F.lit(": "), "content")
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("t")))), lambda x: x["t"]), "\n")


def history_text(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(history_column().alias("history"))


def for_model(messages: DataFrame, summaries: DataFrame) -> DataFrame:
    """(session_id, no, role, content) as a model takes it: the summary first as a system message, 'function' as 'assistant'."""
    kind = messages.schema["no"].dataType
    first = summaries.filter("summary IS NOT NULL").select("session_id", F.lit(-2).cast(kind).alias("no"), F.lit("system").alias("role"), F.col("summary").alias("content"))
    rest = messages.select("session_id", "no", F.when(F.col("role") == "function", "assistant").otherwise(F.col("role")).alias("role"), "content")
    return first.unionByName(rest)


def cleared(messages: DataFrame, session_ids: list[str]) -> DataFrame:
    return messages.filter(~F.col("session_id").isin(session_ids)) if session_ids else messages
