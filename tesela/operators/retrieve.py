"""Retrieval: vector and lexical ranking, reciprocal rank fusion, hybrid, two-stage and multi-query search.

All functions build one lazy plan, for which the queries' vectors and terms are read first. A chunk table has ``id, document_id, paragraph_index,
raw_content, contextualized_text, embedding, parent_chunk_id``. Queries are a table (query_id, query_text, query_vector), so that many
are answered by one plan; its size is checked before it is broadcast. Equal scores are ordered by id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..functions import vectors as vc
from . import scan


@dataclass(frozen=True)
class Options:
    """Knobs of a search and their defaults."""

    vector_weight: float = 0.6
    lexical_weight: float = 0.4
    k: int = 60
    candidate_multiplier: int = 3
    limit: int = 20
    article_bonus: float = 0.5
    include_exact: bool = False
    top_docs: int = 5
    top_k: int = 7
    max_context: int = 20
    rerank: bool = True
    parents: bool = True
    crag_passes: int = 0
    expand: bool = False
    similarity_threshold: float | None = None  # accepted, without effect
    top_paragraphs: int | None = None  # accepted, without effect


#: Queries up to this size are sent to every task; more are joined by blocks of queries.
QUERY_BYTES, QUERY_ROW_BYTES = 32 << 20, 16 << 10


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def few(queries: DataFrame) -> bool:
    """Whether a query table is known to be small; one made of local rows has no estimate, so its rows are counted."""
    return estimated_bytes(queries) <= QUERY_BYTES or queries.count() * QUERY_ROW_BYTES <= QUERY_BYTES


def hinted(df: DataFrame, queries: DataFrame | None) -> DataFrame:
    """``df`` holds a bounded number of rows for each query: it is broadcast where the queries are known to be few."""
    return F.broadcast(df) if queries is not None and few(queries) else df


def beside(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Each chunk beside each query: a stated set of queries against all rows. A large set goes in blocks."""
    if few(queries):
        return chunks.join(F.broadcast(queries))
    blocks = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(64)))
    spread = chunks.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))))
    return spread.join(blocks, "block").drop("block")


def top(df: DataFrame, by: list[Column], n: int, group: str = "query_id", rank: str = "rank") -> DataFrame:
    """First n rows of each group; a rank limit is applied before the shuffle, so each task sends n rows a group."""
    w = Window.partitionBy(group).orderBy(*by)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def top_ids(df: DataFrame, by: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First n ids of each query, rows delivered twice once.

    ``by`` ends in the id, so equal ranks are the deliveries of one row: the ranked rows are made unique, not the table.
    """
    w = Window.partitionBy("query_id").orderBy(*by)
    return df.withColumn(rank, F.dense_rank().over(w)).filter(F.col(rank) <= n).dropDuplicates(["query_id", "id"])


def vector_ranking(chunks: DataFrame, queries: DataFrame, n: int, columns: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, id, distance, rank): the n nearest chunks; chunks without direction come last, null vectors not at all."""
    narrow = chunks.select("id", "embedding", *columns).filter(F.col("embedding").isNotNull())
    near = scan.nearest(narrow, queries, n, columns)
    scored = near.select("query_id", "id", *columns, F.round("distance", 6).alias("distance"))
    return top_ids(scored, [F.asc_nulls_last("distance"), F.asc("id")], n)


def lexical_ranking(chunks: DataFrame, queries: DataFrame, n: int, text: str = "raw_content") -> DataFrame:
    """(query_id, id, score, rank): chunks that hold any term, by the number of positions that do."""
    terms = queries.select("query_id", tx.query_terms(F.col("query_text")).alias("terms")).filter(F.size("terms") > 0)
    words = chunks.select("id", tx.tokens(F.col(text)).alias("words"))
    scored = scan.counted(words, terms, n).select("query_id", "id", F.round(F.lit(0.1) * F.col("positions"), 6).alias("score"))
    return top_ids(scored, [F.desc("score"), F.asc("id")], n)


def bm25_ranking(chunks: DataFrame, queries: DataFrame, n: int, text: str = "raw_content") -> DataFrame:
    """(query_id, id, score, rank) by BM25: an inverted index of the query terms only, aggregated by term and chunk.

    The chunks' words are held against the terms as arrays, so only the words of queries are exploded. Ids must be unique here, since
    the lengths and counts of all chunks weigh.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(tx.query_terms(F.col("query_text")))).alias("term"))
    vocabulary = terms.groupBy().agg(F.collect_set("term").alias("asked"))
    words = chunks.select("id", tx.tokens(F.col(text)).alias("words"))
    stats = words.agg(F.count("*").cast("double").alias("docs"), F.avg(F.size("words")).alias("mean"))
    lengths = words.select("id", F.size("words").alias("length"), "words")
    if few(queries):
        lengths = lengths.join(F.broadcast(vocabulary)).select("id", "length", F.filter("words", lambda w: F.array_contains(F.col("asked"), w)).alias("words"))
    found = lengths.select("id", "length", F.explode("words").alias("term"))
    posting = found.join(hinted(terms.select("term").distinct(), queries), "term").groupBy("term", "id", "length").agg(F.count("*").alias("tf"))
    df = posting.groupBy("term").agg(F.count("*").alias("df"))
    scored = posting.join(hinted(df, queries), "term").join(hinted(terms, queries), "term").join(F.broadcast(stats))  # stats: one row
    part = tx.bm25(F.col("tf"), F.col("df"), F.col("length"), F.col("docs"), F.col("mean"))
    return top(scored.groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score")), [F.desc("score"), F.asc("id")], n)


def fuse(rankings: list[tuple[DataFrame, float]], k: int = 60, key: str = "id", group: str = "query_id") -> DataFrame:
    """(group, key, rrf): weighted reciprocal rank fusion of rankings (group, key, rank), ranks from 1."""
    parts = None
    for ranking, weight in rankings:
        one = ranking.select(group, key, (F.lit(float(weight)) / (F.lit(float(k)) + F.col("rank"))).alias("part"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy(group, key).agg(F.sum("part").alias("rrf"))


def article_hits(chunks: DataFrame, queries: DataFrame, n: int = 50) -> DataFrame:
    """(query_id, id) of chunks that name the article of the query, at most n a query, by id.

    Queries share numbers: the chunks are held against each number once.
    """
    asked = queries.select("query_id", tx.article_number(F.col("query_text")).alias("number")).filter("number IS NOT NULL")
    numbers = asked.select(F.col("number").alias("query_id")).distinct()
    met = beside(chunks.select("id", "raw_content"), numbers).filter(tx.names_article(F.col("raw_content"), F.col("query_id")))
    first = top_ids(met.select("query_id", "id"), [F.asc("id")], n).select(F.col("query_id").alias("number"), "id")
    return asked.join(first, "number").select("query_id", "id").distinct()


def hybrid_ranking(chunks: DataFrame, queries: DataFrame, o: Options = Options()) -> DataFrame:
    """(query_id, id, hybrid_score, rank): vector and lexical candidates fused, exact article references on top.

    The bonus goes to fused chunks only, unless ``include_exact`` adds the others at the bonus alone.
    """
    n = o.limit * o.candidate_multiplier
    vectors, words = vector_ranking(chunks, queries, n), lexical_ranking(chunks, queries, n)
    fused = fuse([(vectors, o.vector_weight), (words, o.lexical_weight)], o.k)
    exact = article_hits(chunks, queries).withColumn("exact", F.lit(True))
    joined = fused.join(exact, ["query_id", "id"], "full" if o.include_exact else "left")
    score = F.coalesce("rrf", F.lit(0.0)) + F.when(F.col("exact"), o.article_bonus).otherwise(0.0)
    return top(joined.select("query_id", "id", F.round(score, 9).alias("hybrid_score")), [F.desc("hybrid_score"), F.asc("id")], o.limit)


def with_chunks(ranking: DataFrame, chunks: DataFrame, documents: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Ranking rows with the columns of their chunk and its document; ranked rows of few queries are sent to the chunks.

    Chunks delivered twice give one row.
    """
    cols = ["id", "document_id", "paragraph_index", "raw_content", "contextualized_text", "parent_chunk_id"]
    docs = documents.select(F.col("id").alias("document_id"), F.col("title").alias("doc_title"), "r2_key", "r2_url")
    return chunks.select(*cols).join(hinted(ranking, queries), "id").dropDuplicates(["query_id", "id"]).join(docs, "document_id")


def hybrid_search(chunks: DataFrame, documents: DataFrame, queries: DataFrame, o: Options = Options(), doc_ids: list[str] | None = None) -> DataFrame:
    """The ``limit`` best chunks of each query with their document. No ids: no filter."""
    inside = chunks.filter(F.col("document_id").isin(doc_ids)) if doc_ids else chunks
    return with_chunks(hybrid_ranking(inside, queries, o), inside, documents, queries)


def document_ranking(documents: DataFrame, queries: DataFrame, n: int = 5) -> DataFrame:
    """(query_id, id, distance, rank) of the documents nearest to each query."""
    return vector_ranking(documents.select("id", F.col("embedding_base").alias("embedding")), queries, n)


def two_stage_search(chunks: DataFrame, documents: DataFrame, queries: DataFrame, o: Options = Options()) -> DataFrame:
    """Documents first, then the chunks of these documents only, for each query by itself."""
    docs = document_ranking(documents, queries, o.top_docs).select("query_id", F.col("id").alias("document_id"))
    inside = chunks.select("id", "document_id", "raw_content", "embedding").join(hinted(docs, queries), "document_id")
    n = o.limit * o.candidate_multiplier
    both = inside.join(hinted(queries, queries), "query_id")
    near = both.filter("embedding IS NOT NULL").select("query_id", "id", F.round(vc.cosine_distance(F.col("embedding"), F.col("query_vector")), 6).alias("distance"))
    vectors = top_ids(near, [F.asc_nulls_last("distance"), F.asc("id")], n)
    words = both.select("query_id", "id", tx.tokens(F.col("raw_content")).alias("words"), tx.query_terms(F.col("query_text")).alias("terms")).filter(F.arrays_overlap("words", "terms"))
    lexical = top_ids(words.select("query_id", "id", F.round(tx.lexical_rank(F.col("words"), F.col("terms")), 6).alias("score")), [F.desc("score"), F.asc("id")], n)
    fused = fuse([(vectors, o.vector_weight), (lexical, o.lexical_weight)], o.k)
    ranked = top(fused.select("query_id", "id", F.round("rrf", 9).alias("hybrid_score")), [F.desc("hybrid_score"), F.asc("id")], o.limit)
    return with_chunks(ranked, chunks, documents, queries)


def multi_query(rankings: DataFrame, n: int = 20, k: int = 60, group: str = "conversation_id") -> DataFrame:
    """(group, id, hybrid_score, rank): the rankings (group, query_id, id, rank) of sub-queries fused without weights."""
    part = F.lit(1.0) / (F.lit(float(k)) + F.col("rank"))
    fused = rankings.groupBy(group, "id").agg(F.round(F.sum(part), 9).alias("hybrid_score"))
    return top(fused, [F.desc("hybrid_score"), F.asc("id")], n, group)


def sub_query_table(questions: DataFrame, embed=None, splitter=None, most: int = 4) -> DataFrame:
    """(conversation_id, query_id, query_text[, query_vector]): the questions cut into at most ``most`` sub-queries."""
    parts = questions.select(F.col("query_id").alias("conversation_id"), F.posexplode(F.slice(tx.sub_queries(F.col("query_text"), splitter), 1, most)).alias("no", "query_text"))
    out = parts.select("conversation_id", F.concat_ws("-", "conversation_id", "no").alias("query_id"), "query_text")
    return out.withColumn("query_vector", embed(F.col("query_text"))) if embed else out


def score_map(chunks: DataFrame, queries: DataFrame, n: int = 1000) -> DataFrame:
    """(query_id, id, document_id, score, rank): similarity 1 - d/2 of the n nearest chunks."""
    near = vector_ranking(chunks, queries, n, ("document_id",))
    return near.select("query_id", "id", "document_id", F.round(vc.map_similarity(F.col("distance")), 7).alias("score"), "rank")


def exact_top_k(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, id, similarity, rank) where zero vectors are at similarity 0: the in-memory ranking of the evaluation."""
    near = beside(rows.select("id", "embedding").filter("embedding IS NOT NULL"), queries.select("query_id", "query_vector"))
    scored = near.select("query_id", "id", F.round(vc.cosine_or_zero(F.col("embedding"), F.col("query_vector")), 6).alias("similarity"))
    return top_ids(scored, [F.desc("similarity"), F.asc("id")], k)


def overlap(a: DataFrame, b: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """(query_id, k, shared): how many of the first k ids two rankings share."""
    both = a.select("query_id", "id", F.col("rank").alias("ra")).join(b.select("query_id", "id", F.col("rank").alias("rb")), ["query_id", "id"])
    spread = both.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    hits = F.sum(F.when((F.col("ra") <= F.col("k")) & (F.col("rb") <= F.col("k")), 1).otherwise(0))
    asked = a.select("query_id").distinct().withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    return asked.join(spread.groupBy("query_id", "k").agg(hits.alias("shared")), ["query_id", "k"], "left").select("query_id", "k", F.coalesce("shared", F.lit(0)).cast("long").alias("shared"))
