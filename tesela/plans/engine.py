"""Whole retrieval requests as one plan: decompose, search, fuse, rerank, parents; the bounded loops around when asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import context as cx
from ..operators import retrieve as rt
from ..operators.retrieve import Options


def answer_sources(questions: DataFrame, tables: dict[str, DataFrame], embed: Callable, o: Options = Options(), splitter: Callable | None = None) -> DataFrame:
    """Sources of each question (query_id, query_text): sub-queries searched in one plan, fused, reranked, with parents.

    Result rows carry ``final_rank``, ``hybrid_score`` of the fusion, ``doc_title`` and ``parent_content``.
    """
    subs = rt.sub_query_table(questions, embed, splitter)
    ranked = rt.hybrid_ranking(tables["document_paragraphs"], subs, o)
    named = ranked.join(subs.select("query_id", "conversation_id"), "query_id")
    fused = rt.multi_query(named, o.max_context).withColumnRenamed("conversation_id", "query_id")
    full = rt.with_chunks(fused, tables["document_paragraphs"], tables["rag_documents"], questions)
    best = cx.rerank(full, o.top_k) if o.rerank else full.withColumn("final_rank", F.col("rank")).withColumn("rerank_score", F.lit(None).cast("double")).filter(F.col("rank") <= o.top_k)
    return cx.with_parents(best, tables["document_parent_chunks"], o.parents)


def simple_sources(queries: DataFrame, tables: dict[str, DataFrame], o: Options = Options()) -> DataFrame:
    """Two-stage request: documents, their chunks, rerank, parents."""
    found = rt.two_stage_search(tables["document_paragraphs"], tables["rag_documents"], queries, o)
    return cx.with_parents(cx.rerank(found, o.top_k), tables["document_parent_chunks"], o.parents)


def contexts(sources: DataFrame) -> DataFrame:
    return cx.context_text(sources)
