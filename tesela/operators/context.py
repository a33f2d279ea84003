"""What happens to ranked chunks: reranking, parents, neighbours, merging, context text, and the bounded loops around."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from .retrieve import top


def rerank(ranked: DataFrame, n: int = 7, score: Column | None = None, weight: float = 0.6) -> DataFrame:
    """The first n of each query.

    Without ``score`` by hybrid score; with one by ``weight`` * score + the rest * hybrid score, a missing score as 0. Queries with at
    most n candidates keep their order and stay unscored.
    """
    few = F.count("*").over(Window.partitionBy("query_id")) <= n
    mixed = F.col("hybrid_score") if score is None else F.lit(weight) * F.coalesce(tx.clamp(score), F.lit(0.0)) + F.lit(1 - weight) * F.col("hybrid_score")
    final = ranked.withColumn("few", few).withColumn("rerank_score", F.when(F.col("few"), F.lit(None)).otherwise(F.round(mixed, 9)))
    order = [F.when(F.col("few"), F.col("rank")).asc_nulls_last(), F.desc_nulls_last("rerank_score"), F.asc("rank"), F.asc("id")]
    return top(final.withColumnRenamed("rank", "first_rank").withColumn("rank", F.col("first_rank")), order, n, rank="final_rank").drop("few", "first_rank")


def cross_encoded(ranked: DataFrame, logits: Callable[[Column, Column], Column], n: int = 7) -> DataFrame:
    """Reranking by a cross-encoder over (query, title and text); ``logits`` builds the column, such as a pandas UDF."""
    passage = F.concat_ws("\n", "doc_title", "raw_content")
    scored = ranked.withColumn("logits", logits(F.col("query_text"), passage)).withColumn("model_score", tx.logit_score(F.col("logits"))).drop("logits")
    return rerank(scored, n, F.col("model_score"), weight=1.0)


def with_parents(ranked: DataFrame, parents: DataFrame, enabled: bool = True) -> DataFrame:
    """Adds ``parent_content`` (null where there is no parent, or where it is switched off)."""
    if not enabled:
        return ranked.withColumn("parent_content", F.lit(None).cast("string"))
    wanted = ranked.select("parent_chunk_id").filter("parent_chunk_id IS NOT NULL").distinct()
    found = parents.select(F.col("id").alias("parent_chunk_id"), F.col("content").alias("parent_content")).join(wanted, "parent_chunk_id", "left_semi")
    return ranked.join(found, "parent_chunk_id", "left")


def neighbours(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks before or after a place: requests (request_id, document_id, paragraph_index, direction, count).

    Nearest first. Only the places asked for are joined; the chunks of a document are narrowed before the ranking.
    """
    asked = requests.select("request_id", "document_id", F.col("paragraph_index").alias("place"), "direction", F.col("count").alias("wanted"))
    met = chunks.join(asked, "document_id")
    side = F.when(F.col("direction") == "before", F.col("paragraph_index") < F.col("place")).otherwise(F.col("paragraph_index") > F.col("place"))
    gap = F.abs(F.col("paragraph_index") - F.col("place"))
    w = Window.partitionBy("request_id").orderBy(gap, "id")
    return met.filter(side).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= F.col("wanted")).drop("place", "wanted")


def merge_sources(first: DataFrame, second: DataFrame, most: int = 20, group: str = "query_id") -> DataFrame:
    """Both lists in order, ``first`` before ``second``, one row for each (document_id, paragraph_index), cut at ``most``."""
    both = first.withColumn("list", F.lit(0)).unionByName(second.withColumn("list", F.lit(1)))
    once = top(both, [F.asc("list"), F.asc("rank"), F.asc("id")], 1, group=F.concat_ws("\u0001", group, "document_id", F.col("paragraph_index").cast("string")), rank="seen")
    return top(once.drop("seen"), [F.asc("list"), F.asc("rank"), F.asc("id")], most, group, rank="place").drop("list")


def resolve_title(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """(request_id, document_id): the first source whose id or title equals the request, or of which one holds the other."""
    s = sources.select("document_id", "doc_title", "rank")
    name = F.col("asked")
    fits = (F.col("document_id") == name) | (F.col("doc_title") == name) | F.col("doc_title").contains(name) | name.contains(F.col("doc_title"))
    met = requests.select("request_id", F.col("doc").alias("asked")).join(F.broadcast(s), fits)
    return top(met, [F.asc("rank"), F.asc("document_id")], 1, "request_id", rank="n").select("request_id", "document_id")


def source_text(number: Column) -> Column:
    """One source of the context: its number, title, fragment and id, then the parent's text or its own."""
    body = F.coalesce("parent_content", "contextualized_text")
    head = F.concat(F.lit("[Fuente "), number.cast("string"), F.lit(" - "), F.col("doc_title"), F.lit(" (fragmento "), F.col("paragraph_index").cast("string"), F.lit(") | id:"), F.col("id"), F.lit("]:\n"))
    return F.concat(head, body)


def context_text(sources: DataFrame, group: str = "query_id", rank: str = "final_rank") -> DataFrame:
    """(group, context): the sources of a query in order, a blank line between them."""
    one = sources.select(group, rank, source_text(F.col(rank)).alias("t"))
    ordered = F.array_sort(F.collect_list(F.struct(rank, "t")))
    return one.groupBy(group).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n").alias("context"))


def no_result(decision: Column, sources: Column) -> Column:
    """Whether the honest answer is that nothing was found."""
    return (decision == "IRRELEVANT") | (sources == 0)


def judge_label(decision: Column, sources: Column) -> Column:
    """Decision of a judge: nothing found is irrelevant; unknown labels and failures (null) count as relevant."""
    known = F.upper(F.trim(decision)).isin("RELEVANT", "IRRELEVANT", "AMBIGUOUS")
    return F.when(sources == 0, "IRRELEVANT").when(known, F.upper(F.trim(decision))).otherwise("RELEVANT")


def expand_context(sources: DataFrame, chunks: DataFrame, documents: DataFrame, decide: Callable[[DataFrame], DataFrame | None], most: int = 20, rounds: int = 4) -> tuple[DataFrame, int]:
    """Grows the sources of one query by neighbours until ``decide`` asks for none, nothing is added or the cap is reached.

    ``decide(sources)`` gives requests (request_id, doc, paragraph_index, direction, count) or None. The list holds at most ``most``
    rows, so each round's count is a small action.
    """
    current, used = sources, 0
    size = current.count()
    while used < rounds and size < most:
        used += 1
        requests = decide(current)
        if requests is None or requests.isEmpty():
            break
        named = requests.join(resolve_title(requests, current), "request_id")
        found = neighbours(named, chunks).withColumn("query_id", F.first("query_id").over(Window.partitionBy())) if "query_id" in chunks.columns else neighbours(named, chunks)
        docs = documents.select(F.col("id").alias("document_id"), F.col("title").alias("doc_title"))
        rows = found.join(docs, "document_id").withColumn("rank", F.col("n"))
        query_id = current.select("query_id").first()[0]
        rows = rows.withColumn("query_id", F.lit(query_id))
        shared = [c for c in current.columns if c in rows.columns]
        merged = merge_sources(current.select(*shared), rows.select(*shared), most).withColumn("rank", F.col("place")).drop("place")
        grown = merged.count()
        current = merged
        if grown == size:
            break
        size = grown
    return current, used


def corrective_passes(sources: DataFrame, judge: Callable[[DataFrame], tuple[str, str | None]], search: Callable[[str], DataFrame], passes: int = 1, most: int = 20) -> tuple[DataFrame, str]:
    """Judges the sources and searches again with the reformulated query, new sources first, as long as passes are left."""
    current, decision = sources, "RELEVANT"
    for _ in range(passes):
        decision, reformulated = judge(current)
        if decision == "RELEVANT" or not reformulated:
            break
        fresh = search(reformulated)
        shared = [c for c in current.columns if c in fresh.columns]
        current = merge_sources(fresh.select(*shared), current.select(*shared), most).withColumn("rank", F.col("place")).drop("place")
    return current, decision
