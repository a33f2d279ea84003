"""Queries of this package for the driver, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from .quality import quality

    rows = table(spark, d, "document_paragraphs").select("id", "raw_content")
    # rows delivered twice are equal in all columns, so the small result is made unique, not the texts
    return quality(rows, "id", "raw_content").filter("NOT is_prose").select("id").distinct()


def _scan_records(spark: SparkSession, d: str) -> DataFrame:
    from .common import records

    return records(spark, d, "rag_documents", "content").unionByName(records(spark, d, "document_paragraphs", "raw_content"))


def p1_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Statistics, robust z-scores and verdict of every paragraph."""
    from .quality import quality

    return quality(table(spark, d, "document_paragraphs").select("id", "raw_content"), "id", "raw_content").dropDuplicates(["id"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from .ocr import scan_damage

    found = scan_damage(_scan_records(spark, d), "rec_id", "text", "rec_table")
    return found.select(F.col("kind").alias("rec_table"), F.col("key").alias("rec_id")).distinct()


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    from .ocr import repaired

    return repaired(_scan_records(spark, d), "rec_id", "text", "rec_table")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from .neardup import near_duplicates, record_pairs

    links, members = near_duplicates(_scan_records(spark, d), "rec_id", "text", "rec_table", similarity=0.6, n=3, least=20)
    return record_pairs(links, members).withColumnRenamed("kind", "rec_table")


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """The group of every record that counts, and the number of links of its class."""
    from .neardup import groups, near_duplicates

    links, members = near_duplicates(_scan_records(spark, d), "rec_id", "text", "rec_table", similarity=0.6, n=3, least=20)
    return groups(links, members).select(F.col("kind").alias("rec_table"), F.col("key").alias("id"), "group_id", "n_links")


#: The size limits of the tables in characters.
LIMITS = {"rag_documents": 6000, "document_parent_chunks": 3500, "document_paragraphs": 1200}
TEXTS = {"rag_documents": "content", "document_parent_chunks": "content", "document_paragraphs": "raw_content"}


def _oversized_pieces(spark: SparkSession, d: str) -> DataFrame:
    from .common import records
    from .split import split_records

    rows = None
    for name in LIMITS:
        one = records(spark, d, name, TEXTS[name])
        rows = one if rows is None else rows.unionByName(one)
    return split_records(rows, "rec_id", "text", kind="rec_table", limits=LIMITS)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = _oversized_pieces(spark, d)
    return pieces.select(F.col("kind").alias("rec_table"), F.col("key").alias("rec_id")).distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    pieces = _oversized_pieces(spark, d)
    return pieces.select(F.col("kind").alias("rec_table"), F.col("key").alias("rec_id"), "piece", "start", "end", "piece_text")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from .truncate import truncated_answers, truncated_copies

    answers = table(spark, d, "query_evaluations").select(F.lit("query_evaluations").alias("kind"), "id", "answer_text")
    contexts = table(spark, d, "document_paragraphs").select(F.lit("document_paragraphs").alias("kind"), "id", "contextualized_text", "raw_content")
    found = truncated_answers(answers, "id", "answer_text").unionByName(truncated_copies(contexts, "id", "contextualized_text", "raw_content"))
    return found.select(F.col("kind").alias("rec_table"), F.col("key").alias("rec_id"))


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of cut records per channel and per source of the documents."""
    from .truncate import truncation_rates

    found = p5_found(spark, d).withColumnRenamed("rec_id", "key")
    answers = table(spark, d, "query_evaluations").select("id", "channel")
    docs = table(spark, d, "rag_documents").select(F.col("id").alias("document_id"), F.col("metadata.fuente").alias("fuente"))
    contexts = table(spark, d, "document_paragraphs").select("id", "document_id").join(docs, "document_id", "left")
    a = truncation_rates(found.filter("rec_table = 'query_evaluations'"), answers, "id", "channel")
    b = truncation_rates(found.filter("rec_table = 'document_paragraphs'"), contexts, "id", "fuente")
    return a.select(F.lit("query_evaluations").alias("rec_table"), "*").unionByName(b.select(F.lit("document_paragraphs").alias("rec_table"), "*"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = None
    for name, vec in (("document_paragraphs", "embedding"), ("rag_documents", "embedding_base")):
        one = table(spark, d, name).select(F.lit(name).alias("rec_table"), "id", F.col(vec).alias("v"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 5 most similar records of every record whose hashed id is divisible by 50, however far they are."""
    from .knn import scan_top_k

    rows = _vectors(spark, d)
    asked = rows.filter(F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("long") % 50 == 0)
    return scan_top_k(rows, asked, "id", "v", "rec_table").withColumnRenamed("kind", "rec_table")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from .knn import similar

    return similar(_vectors(spark, d), "id", "v", "rec_table").select(F.col("kind").alias("rec_table"), "id_a", "id_b")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from .pack import byte_tokens, pack

    docs = table(spark, d, "documents").select("doc_id", "text")
    packed = pack(docs, "doc_id", byte_tokens(F.col("text")))
    return packed.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, or of its pieces."""
    from .pack import byte_tokens, pack

    return pack(table(spark, d, "documents").select("doc_id", "text"), "doc_id", byte_tokens(F.col("text")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    from .leak import leaked

    return leaked(table(spark, d, "documents"), table(spark, d, "heldout_items")).select("doc_id", "item_id")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    from .toxic import content_scores

    return content_scores(table(spark, d, "documents"), table(spark, d, "moderation_labels"))


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score, E-value and strongest passage of every document."""
    return _scores(spark, d)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).filter("n_passages > 0").select("doc_id")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of documents with such passages per source."""
    from .toxic import content_rates

    return content_rates(_scores(spark, d), table(spark, d, "documents"))


QUERIES = {"p1_found": p1_found, "p1_statistics": p1_statistics, "p2_found": p2_found, "p2_repaired": p2_repaired, "p3_found": p3_found, "p3_groups": p3_groups, "p4_found": p4_found, "p4_pieces": p4_pieces, "p5_found": p5_found, "p5_rates": p5_rates, "p6_found": p6_found, "p6_neighbours": p6_neighbours, "p7_found": p7_found, "p7_packed": p7_packed, "p8_found": p8_found, "p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates}

# --- SQL ----------------------------------------------------------------------------------------------------------------------


def _union(parts: dict[str, str]) -> str:
    """(rec_table, rec_id, x) of the stated column of each table, rows delivered twice once."""
    one = "SELECT '{0}' AS rec_table, id AS rec_id, any_value({1}) AS x FROM {0} GROUP BY id"
    return " UNION ALL ".join(one.format(name, col) for name, col in parts.items())


_SCANNED = _union({"rag_documents": "content", "document_paragraphs": "raw_content"})
_UNITS = (
    "r AS (" + _union({"document_paragraphs": "embedding::DOUBLE[]", "rag_documents": "embedding_base::DOUBLE[]"}) + "), "
    "u AS (SELECT rec_table, rec_id, x, sqrt(list_inner_product(x, x)) AS n FROM r WHERE x IS NOT NULL AND list_inner_product(x, x) > 0)"
)
_COS = "list_inner_product(a.x, b.x) / (a.n * b.n)"
_NEAR = (
    "t AS (SELECT a.rec_table, a.rec_id AS q, b.rec_id AS k, {cos} AS c FROM u a JOIN u b ON a.rec_table = b.rec_table AND a.rec_id != b.rec_id {where} "
    "QUALIFY row_number() OVER (PARTITION BY a.rec_table, a.rec_id ORDER BY c DESC, b.rec_id) <= 5)"
)
_TENTH = "WHERE ('0x' || substr(md5(a.rec_id), 1, 8))::BIGINT % 50 = 0"
_WORDS = "regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+')"
_GRAMS = "(SELECT {0}, array_to_string(w[k:k + 15], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 14)) AS k FROM {1}))"
SQL: dict[str, str] = {
    "p3_found": (
        f"WITH r AS ({_SCANNED}), w AS (SELECT rec_table, rec_id, regexp_extract_all(lower(x), '[\\p{{L}}\\p{{N}}]+') AS w FROM r), "
        "g AS (SELECT DISTINCT rec_table, rec_id, hash(w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM w)), "
        "n AS (SELECT rec_table, rec_id, count(*) AS n FROM g GROUP BY ALL HAVING n >= 20), k AS (SELECT g.*, n.n FROM g JOIN n USING (rec_table, rec_id)), "
        "p AS (SELECT a.rec_table, a.rec_id AS id_a, b.rec_id AS id_b, a.n + b.n AS s, count(*) AS c FROM k a JOIN k b ON a.rec_table = b.rec_table AND a.g = b.g "
        "AND a.rec_id < b.rec_id AND least(a.n, b.n) >= 0.6 * greatest(a.n, b.n) GROUP BY ALL) SELECT rec_table, id_a, id_b FROM p WHERE c >= 0.6 * (s - c)"
    ),
    "p4_found": "SELECT DISTINCT rec_table, rec_id FROM ("
    + " UNION ALL ".join(f"SELECT '{name}' AS rec_table, id AS rec_id FROM {name} WHERE length({TEXTS[name]}) > {limit}" for name, limit in LIMITS.items())
    + ")",
    "p6_found": f"WITH {_UNITS}, {_NEAR.format(cos=_COS, where='')} SELECT DISTINCT rec_table, least(q, k) AS id_a, greatest(q, k) AS id_b FROM t WHERE c >= 0.9",
    "p6_neighbours": (
        f"WITH {_UNITS}, {_NEAR.format(cos=f'round({_COS}, 6)', where=_TENTH)} "
        "SELECT rec_table, q AS query, k AS key, c AS cosine, row_number() OVER (PARTITION BY rec_table, q ORDER BY c DESC, k) AS rank FROM t"
    ),
    "p7_found": "SELECT doc_id FROM documents WHERE octet_length(encode(text)) + 1 > 4096",
    "p8_found": (
        f"WITH i AS (SELECT item_id, {_WORDS} AS w FROM heldout_items), d AS (SELECT doc_id, {_WORDS} AS w FROM documents) "
        f"SELECT DISTINCT doc_id, item_id FROM {_GRAMS.format('doc_id', 'd')} JOIN {_GRAMS.format('item_id', 'i')} USING (g)"
    ),
}
