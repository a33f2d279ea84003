"""Evaluation of answers, of embeddings and of chunking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx


def statistics(evaluations: DataFrame, exclude_failed: bool = False) -> DataFrame:
    """One row: counts and rounded averages. Failed evaluations (-1) lower the averages unless they are excluded."""
    done = F.col("evaluated")

    def mean(c: str, when: Column | None = None) -> Column:
        x = F.col(c).cast("decimal(18,3)")
        keep = when if when is not None else F.lit(True)
        if exclude_failed:
            keep = keep & (F.col(c) >= 0)
        return F.avg(F.when(keep, x))

    return evaluations.agg(
        F.count("*").alias("total"),
        F.count_if(done).alias("evaluated"),
        F.count_if(~done).alias("pending"),
        F.round(mean("faithfulness_score", done), 3).cast("double").alias("avg_faithfulness"),
        F.round(mean("answer_relevance_score", done), 3).cast("double").alias("avg_relevance"),
        F.round(mean("latency_ms"), 1).cast("double").alias("avg_latency_ms"),
        F.round(mean("iterations"), 2).cast("double").alias("avg_iterations"),
    )


def recent(evaluations: DataFrame, limit: int | None = 20, most: int = 100) -> DataFrame:
    """The newest evaluations, between 1 and ``most`` of them; ties by id."""
    n = max(1, min(limit or 20, most))
    cols = ["id", "query_text", "sources_count", "crag_decision", "iterations", "latency_ms", "faithfulness_score", "answer_relevance_score", "evaluated", "created_at"]
    return evaluations.select(*cols).orderBy(F.desc("created_at"), F.asc("id")).limit(n)


def buckets(evaluations: DataFrame) -> DataFrame:
    """(badge, decision, n): evaluated answers by the badge of their faithfulness and their decision."""
    rows = evaluations.filter("evaluated").select(tx.badge(F.col("faithfulness_score")).alias("badge"), F.coalesce("crag_decision", F.lit("none")).alias("decision"))
    return rows.groupBy("badge", "decision").agg(F.count("*").alias("n"))


def with_scores(evaluations: DataFrame, scores: DataFrame) -> DataFrame:
    """Evaluations with the scores (id, faithfulness, relevance, failed) of a judge; failures are -1 and count as evaluated."""
    new = scores.select("id", *(F.when(F.col("failed"), F.lit(-1.0)).otherwise(tx.clamp(F.col(c))).cast("decimal(4,3)").alias(c) for c in ("faithfulness", "relevance")), F.lit(True).alias("scored"))
    both = evaluations.join(new, "id", "left")
    return both.withColumns(
        {
            "faithfulness_score": F.coalesce("faithfulness", "faithfulness_score"),
            "answer_relevance_score": F.coalesce("relevance", "answer_relevance_score"),
            "evaluated": F.coalesce("scored", "evaluated"),
        }
    ).drop("faithfulness", "relevance", "scored")


def judge_input(answer: Column, sources: Column) -> Column:
    """What a judge sees: 300 characters of each source, 1500 of all, 800 of the answer."""
    context = F.substring(F.array_join(F.transform(sources, lambda s: F.substring(s, 1, 300)), "\n\n"), 1, 1500)
    return F.struct(context.alias("context"), F.substring(answer, 1, 800).alias("answer"))


def chunking_report(chunks: DataFrame, boundaries: DataFrame, by: str = "document_id") -> DataFrame:
    """(by, chunks, avg_chars, max_chars, avg_distance, on_boundary, with_path): how well chunks meet structural boundaries.

    chunks (by, start, chars, context_path), boundaries (by, at). The nearest boundary of a start is the last one before or the
    first one after it in sorted order, so no chunk is compared with every boundary.
    """
    marks = boundaries.select(by, F.col("at").alias("pos"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("chars"), F.lit(None).cast("string").alias("context_path"))
    starts = chunks.select(by, F.col("start").alias("pos"), F.lit(1).alias("kind"), F.col("chars").cast("long").alias("chars"), "context_path")
    both = marks.unionByName(starts)
    mark = F.when(F.col("kind") == 0, F.col("pos"))
    before = F.last(mark, ignorenulls=True).over(Window.partitionBy(by).orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(mark, ignorenulls=True).over(Window.partitionBy(by).orderBy("pos", F.desc("kind")).rowsBetween(0, Window.unboundedFollowing))
    near = both.withColumn("b", before).withColumn("a", after).filter("kind = 1")
    near = near.withColumn("distance", F.least(F.col("pos") - F.col("b"), F.col("a") - F.col("pos")))
    return near.groupBy(by).agg(
        F.count("*").alias("chunks"),
        F.round(F.avg("chars"), 2).alias("avg_chars"),
        F.max("chars").alias("max_chars"),
        F.round(F.avg("distance"), 2).alias("avg_distance"),
        F.round(F.avg(F.when(F.col("distance") <= 1, 100.0).otherwise(0.0)), 2).alias("on_boundary"),
        F.round(F.avg(F.when(F.coalesce("context_path", F.lit("")) != "", 100.0).otherwise(0.0)), 2).alias("with_path"),
    )
