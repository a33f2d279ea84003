"""One query for each operator over the test tables, whole tables throughout, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..functions import vectors as vc
from ..operators import chunk as ck
from ..operators import context as cx
from ..operators import evaluate as ev
from ..operators import graph as gr
from ..operators import inventory as inv
from ..operators import layout as ly
from ..operators import memory as mem
from ..operators import retrieve as rt
from ..session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- inputs -----------------------------------------------------------------------------------------------------------------


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "rag_documents")


def _paras(s: SparkSession, d: str, *cols: str) -> DataFrame:
    """Paragraphs, rows delivered twice once; only the named columns pass the shuffle."""
    df = table(s, d, "document_paragraphs")
    return inv.unique(df.select("id", *cols) if cols else df)


def _evals(s: SparkSession, d: str) -> DataFrame:
    return inv.unique(table(s, d, "query_evaluations"))


def _chunks(s: SparkSession, d: str) -> DataFrame:
    """Paragraphs as they were delivered; searches make their candidates unique instead of the table."""
    return table(s, d, "document_paragraphs")


def _queries(s: SparkSession, d: str) -> DataFrame:
    """The stated query set: every document whose hashed id is divisible by 50, its title with an article and its vector."""
    asked = _docs(s, d).select("id", "title", "embedding_base").filter(F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("long") % 50 == 0)
    return asked.select(F.col("id").alias("query_id"), F.concat("title", F.lit(" artículo 5 y multa")).alias("query_text"), F.col("embedding_base").alias("query_vector"))


P = "p AS (SELECT * FROM document_paragraphs QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at) = 1)"
E = "e AS (SELECT * FROM query_evaluations QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at) = 1)"
Q = "q AS (SELECT id AS query_id, title || ' artículo 5 y multa' AS query_text, embedding_base::DOUBLE[] AS qv FROM rag_documents WHERE ('0x' || substr(md5(id), 1, 8))::BIGINT % 50 = 0)"


def _norm(a: str) -> str:
    return f"sqrt(list_inner_product({a}, {a}))"


def _cos(a: str, b: str) -> str:
    return f"CASE WHEN {_norm(a)} * {_norm(b)} > 0 THEN list_inner_product({a}, {b}) / ({_norm(a)} * {_norm(b)}) END"


def _dist(a: str, b: str) -> str:
    return f"round(1 - ({_cos(a, b)}), 6)"


WORDS = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}]+')"
TERMS = "list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^0-9A-Za-z_\\sáéíóúüñ]', ' ', 'g'), '\\s+'), lambda t: length(t) > 2 OR regexp_full_match(t, '[0-9]+'))"


def _vec(n: int, where: str = "", src: str = "p", col: str = "embedding", name: str = "v") -> str:
    return (
        f"{name} AS (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance ASC NULLS LAST, id) AS rank FROM "
        f"(SELECT q.query_id, c.id, {_dist(f'c.{col}::DOUBLE[]', 'q.qv')} AS distance FROM {src} c, q WHERE c.{col} IS NOT NULL {where}) QUALIFY rank <= {n})"
    )


def _lex(n: int, src: str = "p", name: str = "l", on: str = "") -> str:
    return (
        f"{name} AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM "
        f"(SELECT q.query_id, c.id, round(0.1::DOUBLE * len(list_filter({WORDS.format('c.raw_content')}, lambda t: list_contains({TERMS.format('q.query_text')}, t))), 6) AS score "
        f"FROM {src} c, q {on}) WHERE score > 0 QUALIFY rank <= {n})"
    )


def _fused(k: str = "f") -> str:
    return (
        f"{k} AS (SELECT query_id, id, sum(part) AS rrf FROM (SELECT query_id, id, 0.6::DOUBLE / (60.0::DOUBLE + rank) AS part FROM v "
        "UNION ALL SELECT query_id, id, 0.4::DOUBLE / (60.0::DOUBLE + rank) FROM l) GROUP BY ALL)"
    )


EXACT = (
    "x AS (SELECT query_id, id FROM (SELECT q.query_id, p.id FROM p, q WHERE regexp_matches(p.raw_content, '(?i)art(?:ículo|ÍCULO|iculo)?\\.?\\s*' || "
    "regexp_extract(q.query_text, '(?i)art(?:ículo|iculo)?\\.?\\s*([0-9]+)', 1) || '([^0-9]|$)')) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY id) <= 50)"
)
HYBRID = (
    f"h AS (SELECT query_id, id, hybrid_score, row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, id) AS rank FROM (SELECT f.query_id, f.id, "
    "round(rrf + CASE WHEN x.id IS NULL THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END, 9) AS hybrid_score FROM f LEFT JOIN x USING (query_id, id)) QUALIFY rank <= 20)"
)
# chunks whose document is missing are no candidates for reranking
WITH_DOC = "hd AS (SELECT h.query_id, h.id, hybrid_score, row_number() OVER (PARTITION BY h.query_id ORDER BY hybrid_score DESC, h.rank, h.id) AS rank FROM h JOIN p ON p.id = h.id JOIN rag_documents d ON d.id = p.document_id)"
HYBRID_CTES = ", ".join([P, Q, _vec(60), _lex(60), _fused(), EXACT, HYBRID, WITH_DOC])


# --- retrieval --------------------------------------------------------------------------------------------------------------


@query(f"WITH {HYBRID_CTES} SELECT h.query_id, h.id, hybrid_score, rank, d.title AS doc_title, p.paragraph_index FROM h JOIN p USING (id) JOIN rag_documents d ON d.id = p.document_id")
def hybrid_search(s, d):
    found = rt.hybrid_search(_chunks(s, d), _docs(s, d), _queries(s, d))
    return found.select("query_id", "id", "hybrid_score", "rank", "doc_title", "paragraph_index")


@query(f"WITH {P}, {Q}, {_vec(60)} SELECT query_id, id, distance, rank FROM v")
def vector_topk(s, d):
    return rt.vector_ranking(_chunks(s, d), _queries(s, d), 60)


@query(f"WITH {P}, {Q}, i AS (SELECT id FROM rag_documents ORDER BY created_at, id LIMIT 20), {_vec(60, 'AND c.document_id IN (SELECT id FROM i)')} SELECT query_id, id, distance, rank FROM v")
def vector_topk_filtered(s, d):
    ids = _docs(s, d).select("id", "created_at").orderBy("created_at", "id").limit(20).select(F.col("id").alias("document_id"))
    inside = _chunks(s, d).select("id", "document_id", "embedding").join(F.broadcast(ids), "document_id", "left_semi")
    return rt.vector_ranking(inside, _queries(s, d), 60)


@query(f"WITH {P}, {Q}, {_lex(60)} SELECT query_id, id, score, rank FROM l")
def lexical_topk(s, d):
    return rt.lexical_ranking(_chunks(s, d), _queries(s, d), 60)


@query(
    f"WITH {P}, {Q}, w AS (SELECT id, {WORDS.format('raw_content')} AS words FROM p), t AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest({TERMS.format('query_text')}) AS term FROM q)), "
    "s AS (SELECT count(*)::DOUBLE AS docs, avg(len(words)) AS mean FROM w), o AS (SELECT id, len(words) AS n, unnest(words) AS term FROM w), "
    "g AS (SELECT term, id, n, count(*) AS tf FROM o WHERE term IN (SELECT term FROM t) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM g GROUP BY term), "
    "r AS (SELECT query_id, id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))), 6) AS score FROM g JOIN f USING (term) JOIN t USING (term), s GROUP BY query_id, id) "
    "SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM r QUALIFY rank <= 60"
)
def bm25_topk(s, d):
    return rt.bm25_ranking(_paras(s, d, "raw_content"), _queries(s, d), 60)


@query(f"WITH {P}, {Q}, {EXACT} SELECT query_id, id FROM x")
def article_boost(s, d):
    return rt.article_hits(_chunks(s, d), _queries(s, d))


@query(f"WITH {P}, {Q}, {_vec(20)} SELECT 'all' AS conversation_id, id, hybrid_score, row_number() OVER (ORDER BY hybrid_score DESC, id) AS rank FROM (SELECT id, round(sum(1.0::DOUBLE / (60.0::DOUBLE + rank)), 9) AS hybrid_score FROM v GROUP BY id) QUALIFY rank <= 20")
def rrf_multi_query(s, d):
    ranked = rt.vector_ranking(_chunks(s, d), _queries(s, d), 20)
    return rt.multi_query(ranked.withColumn("conversation_id", F.lit("all")))


@query(
    f"WITH {P}, {Q}, d5 AS (SELECT query_id, id AS document_id FROM (SELECT q.query_id, c.id, {_dist('c.embedding_base::DOUBLE[]', 'q.qv')} AS distance FROM rag_documents c, q WHERE c.embedding_base IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance ASC NULLS LAST, id) <= 5), "
    + _vec(60, "AND (q.query_id, c.document_id) IN (SELECT query_id, document_id FROM d5)")
    + ", "
    + _lex(60, on="WHERE (q.query_id, c.document_id) IN (SELECT query_id, document_id FROM d5)")
    + f", {_fused()} SELECT query_id, id, hybrid_score, rank, title AS doc_title FROM (SELECT query_id, id, round(rrf, 9) AS hybrid_score, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 9) DESC, id) AS rank FROM f QUALIFY rank <= 20) JOIN p USING (id) JOIN rag_documents d ON d.id = p.document_id"
)
def two_stage(s, d):
    found = rt.two_stage_search(_chunks(s, d), _docs(s, d), _queries(s, d))
    return found.select("query_id", "id", "hybrid_score", "rank", "doc_title")


@query(f"WITH {P}, {Q}, {_vec(1000)} SELECT query_id, v.id, document_id, round(greatest(0.0::DOUBLE, 1 - distance / 2), 7) AS score, rank FROM v JOIN p ON p.id = v.id")
def score_map(s, d):
    return rt.score_map(_chunks(s, d), _queries(s, d))


@query(
    f"WITH {Q}, {_vec(10, src='rag_documents', col='embedding_base', name='a')}, b0 AS (SELECT vec_id, embedding FROM embeddings), "
    f"v AS (SELECT query_id, id, distance, rank FROM a), m AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id DESC) AS rank FROM (SELECT q.query_id, c.id, round(list_inner_product(c.embedding_base::DOUBLE[], q.qv), 6) AS s FROM rag_documents c, q WHERE c.embedding_base IS NOT NULL) QUALIFY rank <= 10), "
    "k AS (SELECT unnest([5, 10]) AS k) SELECT q.query_id, k.k, count(m.id)::BIGINT AS shared FROM q CROSS JOIN k LEFT JOIN v ON v.query_id = q.query_id AND v.rank <= k.k LEFT JOIN m ON m.query_id = q.query_id AND m.id = v.id AND m.rank <= k.k GROUP BY ALL"
)
def overlap_at_k(s, d):
    """Ranking by cosine against ranking by inner product."""
    docs = _docs(s, d).select("id", F.col("embedding_base").alias("embedding"))
    a = rt.vector_ranking(docs, _queries(s, d), 10)
    near = rt.beside(docs.filter("embedding IS NOT NULL"), _queries(s, d).select("query_id", "query_vector"))
    scored = near.select("query_id", "id", F.round(vc.dot(F.col("embedding"), F.col("query_vector")), 6).alias("s"))
    return rt.overlap(a, rt.top(scored, [F.desc("s"), F.desc("id")], 10))


@query(f"WITH {Q} SELECT q.query_id, c.id, round(list_inner_product(c.embedding_base::DOUBLE[], q.qv) / (CASE WHEN {_norm('c.embedding_base::DOUBLE[]')} = 0 THEN 1 ELSE {_norm('c.embedding_base::DOUBLE[]')} END * CASE WHEN {_norm('q.qv')} = 0 THEN 1 ELSE {_norm('q.qv')} END), 6) AS similarity, row_number() OVER (PARTITION BY q.query_id ORDER BY similarity DESC, c.id) AS rank FROM rag_documents c, q WHERE c.embedding_base IS NOT NULL QUALIFY rank <= 10")
def exact_topk(s, d):
    return rt.exact_top_k(_docs(s, d).select("id", F.col("embedding_base").alias("embedding")), _queries(s, d))


# --- context ----------------------------------------------------------------------------------------------------------------


def _hybrid_rows(s, d):
    return rt.hybrid_search(_chunks(s, d), _docs(s, d), _queries(s, d))


@query(f"WITH {HYBRID_CTES} SELECT query_id, id, hybrid_score, rank AS final_rank FROM hd WHERE rank <= 7")
def rerank_hybrid(s, d):
    return cx.rerank(_hybrid_rows(s, d)).select("query_id", "id", "hybrid_score", "final_rank")


BLEND = "b AS (SELECT h.query_id, h.id, h.rank, round(0.6::DOUBLE * least(1.0::DOUBLE, length(p.raw_content) / 1000.0::DOUBLE) + (1 - 0.6)::DOUBLE * hybrid_score, 9) AS rerank_score FROM hd h JOIN p USING (id))"


@query(f"WITH {HYBRID_CTES}, {BLEND} SELECT query_id, id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank, id) AS final_rank FROM b QUALIFY final_rank <= 7")
def rerank_blend(s, d):
    """Half model, half fusion; the stand-in for the model is the length of the text."""
    return cx.rerank(_hybrid_rows(s, d), score=F.length("raw_content") / 1000.0).select("query_id", "id", "rerank_score", "final_rank")


@query(f"WITH {HYBRID_CTES} SELECT query_id, h.id, rank, c.content AS parent_content FROM hd h JOIN p ON p.id = h.id LEFT JOIN document_parent_chunks c ON c.id = p.parent_chunk_id WHERE rank <= 7")
def parent_enrich(s, d):
    best = cx.rerank(_hybrid_rows(s, d)).withColumn("rank", F.col("final_rank"))
    return cx.with_parents(best, table(s, d, "document_parent_chunks")).select("query_id", "id", "rank", "parent_content")


@query(
    f"WITH {HYBRID_CTES}, b AS (SELECT h.query_id, h.rank, '[Fuente ' || rank || ' - ' || d.title || ' (fragmento ' || p.paragraph_index || ') | id:' || p.id || ']:' || chr(10) || coalesce(c.content, p.contextualized_text) AS t "
    "FROM hd h JOIN p ON p.id = h.id JOIN rag_documents d ON d.id = p.document_id LEFT JOIN document_parent_chunks c ON c.id = p.parent_chunk_id WHERE rank <= 7) SELECT query_id, string_agg(t, chr(10) || chr(10) ORDER BY rank) AS context FROM b GROUP BY query_id"
)
def context_assembly(s, d):
    return cx.context_text(cx.with_parents(cx.rerank(_hybrid_rows(s, d)), table(s, d, "document_parent_chunks")))


def _adjacent(s, d, direction):
    first = _docs(s, d).select("id").orderBy("id")
    asked = first.select(F.col("id").alias("request_id"), F.col("id").alias("document_id"), F.lit(4).alias("paragraph_index"), F.lit(direction).alias("direction"), F.lit(2).alias("count"))
    return cx.neighbours(asked, _paras(s, d, "document_id", "paragraph_index")).select("request_id", "id", "paragraph_index", "n")


_ADJ = f"WITH {P} SELECT d.id AS request_id, p.id, p.paragraph_index, row_number() OVER (PARTITION BY d.id ORDER BY abs(p.paragraph_index - 4), p.id)::INT AS n FROM rag_documents d JOIN p ON p.document_id = d.id WHERE p.paragraph_index {{}} 4 QUALIFY n <= 2"


@query(_ADJ.format("<"))
def adjacent_before(s, d):
    return _adjacent(s, d, "before")


@query(_ADJ.format(">"))
def adjacent_after(s, d):
    return _adjacent(s, d, "after")


@query(
    f"WITH {P}, {Q}, {_vec(15)}, {_lex(15)}, u AS (SELECT query_id, id, 0 AS list, rank FROM v UNION ALL SELECT query_id, id, 1, rank FROM l), "
    "o AS (SELECT u.*, p.document_id, p.paragraph_index FROM u JOIN p USING (id) QUALIFY row_number() OVER (PARTITION BY query_id, p.document_id, p.paragraph_index ORDER BY list, rank, id) = 1) "
    "SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY list, rank, id) AS place FROM o QUALIFY place <= 20"
)
def merge_dedup(s, d):
    chunks, q = _chunks(s, d), _queries(s, d)
    place = chunks.select("id", "document_id", "paragraph_index")
    a = place.join(rt.hinted(rt.vector_ranking(chunks, q, 15).select("query_id", "id", "rank"), q), "id")
    b = place.join(rt.hinted(rt.lexical_ranking(chunks, q, 15).select("query_id", "id", "rank"), q), "id")
    return cx.merge_sources(a, b).select("query_id", "id", "place")


# --- evaluation -------------------------------------------------------------------------------------------------------------


@query(
    f"WITH {E} SELECT count(*) AS total, count(*) FILTER (WHERE evaluated) AS evaluated, count(*) FILTER (WHERE NOT evaluated) AS pending, round(avg(faithfulness_score) FILTER (WHERE evaluated), 3)::DOUBLE AS avg_faithfulness, "
    "round(avg(answer_relevance_score) FILTER (WHERE evaluated), 3)::DOUBLE AS avg_relevance, round(avg(latency_ms), 1)::DOUBLE AS avg_latency_ms, round(avg(iterations), 2)::DOUBLE AS avg_iterations FROM e"
)
def eval_stats(s, d):
    return ev.statistics(_evals(s, d))


@query(f"WITH {E} SELECT id, query_text, sources_count, crag_decision, iterations, latency_ms, faithfulness_score, answer_relevance_score, evaluated, created_at FROM e ORDER BY created_at DESC, id LIMIT 20")
def eval_recent(s, d):
    return ev.recent(_evals(s, d))


@query(f"WITH {E} SELECT CASE WHEN faithfulness_score IS NULL THEN 'none' WHEN faithfulness_score >= 0.8 THEN 'good' WHEN faithfulness_score >= 0.6 THEN 'mid' ELSE 'bad' END AS badge, coalesce(crag_decision, 'none') AS decision, count(*) AS n FROM e WHERE evaluated GROUP BY ALL")
def eval_buckets(s, d):
    return ev.buckets(_evals(s, d))


@query(f"WITH {E} SELECT id, substr(answer_text, 1, 800) AS answer FROM e")
def judge_input(s, d):
    return _evals(s, d).select("id", ev.judge_input(F.col("answer_text"), F.array("query_text")).getField("answer").alias("answer"))


@query(f"WITH {E} SELECT id, CASE WHEN sources_count = 0 THEN 'IRRELEVANT' WHEN upper(trim(crag_decision)) IN ('RELEVANT', 'IRRELEVANT', 'AMBIGUOUS') THEN upper(trim(crag_decision)) ELSE 'RELEVANT' END AS decision, (decision = 'IRRELEVANT' OR sources_count = 0) AS no_result FROM e")
def crag_labels(s, d):
    rows = _evals(s, d).select("id", "sources_count", cx.judge_label(F.col("crag_decision"), F.col("sources_count")).alias("decision"))
    return rows.select("id", "decision", cx.no_result(F.col("decision"), F.col("sources_count")).alias("no_result"))


@query(f"WITH {E} SELECT id, round(1 / (1 + exp(-(latency_ms / 1000.0::DOUBLE - 3))), 9) AS score FROM e WHERE latency_ms IS NOT NULL")
def logit_sigmoid(s, d):
    rows = _evals(s, d).filter("latency_ms IS NOT NULL")
    return rows.select("id", F.round(tx.logit_score(F.array(F.col("latency_ms") / 1000.0 - 3)), 9).alias("score"))


@query(f"WITH {E} SELECT id, round(exp(sources_count::DOUBLE - greatest(iterations::DOUBLE, sources_count::DOUBLE)) / (exp(iterations::DOUBLE - greatest(iterations::DOUBLE, sources_count::DOUBLE)) + exp(sources_count::DOUBLE - greatest(iterations::DOUBLE, sources_count::DOUBLE))), 9) AS score FROM e")
def logit_softmax(s, d):
    return _evals(s, d).select("id", F.round(tx.logit_score(F.array(F.col("iterations").cast("double"), F.col("sources_count").cast("double"))), 9).alias("score"))


@query(f"WITH {E} SELECT id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(faithfulness_score::DOUBLE, 0.0::DOUBLE))) AS score FROM e")
def score_clamp(s, d):
    return _evals(s, d).select("id", tx.clamp(F.col("faithfulness_score")).alias("score"))


@query(f"WITH {E} SELECT id, CASE WHEN NOT evaluated THEN CASE WHEN latency_ms IS NULL THEN -1.0 ELSE 0.5 END ELSE faithfulness_score END::DOUBLE AS faithfulness_score, TRUE AS evaluated FROM e")
def eval_update(s, d):
    rows = _evals(s, d)
    new = rows.filter("NOT evaluated").select("id", F.lit(0.5).alias("faithfulness"), F.lit(0.5).alias("relevance"), F.col("latency_ms").isNull().alias("failed"))
    return ev.with_scores(rows, new).select("id", F.col("faithfulness_score").cast("double").alias("faithfulness_score"), "evaluated")


# --- inventory, integrity, maintenance --------------------------------------------------------------------------------------


@query(f"WITH {P} SELECT d.id, d.title, d.mime_type, d.created_at, count(p.id) AS n_paragraphs FROM rag_documents d LEFT JOIN p ON p.document_id = d.id GROUP BY ALL")
def doc_inventory(s, d):
    return inv.counts(_docs(s, d), _paras(s, d, "document_id"))


@query(f"WITH {P} SELECT id, title, mime_type, created_at, (SELECT count(*) FROM p WHERE p.document_id = d.id) AS n_paragraphs FROM (SELECT * FROM rag_documents ORDER BY created_at DESC, id LIMIT 10) d")
def recent_with_counts(s, d):
    return inv.newest_with_counts(_docs(s, d), _paras(s, d, "document_id"))


@query(f"WITH {P} SELECT id, paragraph_index, parent_chunk_id, metadata.context_path AS context_path, length(raw_content) AS n_chars FROM p WHERE document_id = (SELECT min(id) FROM rag_documents)")
def doc_chunks(s, d):
    first = _docs(s, d).agg(F.min("id")).first()[0]
    return inv.listing(_paras(s, d, "document_id", "paragraph_index", "parent_chunk_id", "metadata", "raw_content"), first)


@query(f"WITH {P} SELECT p.id, p.document_id, p.paragraph_index FROM p LEFT JOIN rag_documents d ON d.id = p.document_id WHERE d.id IS NULL")
def orphans(s, d):
    return inv.orphans(_paras(s, d, "document_id", "paragraph_index"), _docs(s, d)).select("id", "document_id", "paragraph_index")


@query("SELECT d.id, d.title, d.r2_key FROM rag_documents d WHERE NOT EXISTS (SELECT 1 FROM document_entities e WHERE e.document_id = d.id)")
def empty_docs(s, d):
    """Documents without entities (every test document has paragraphs)."""
    return inv.empty_documents(_docs(s, d), table(s, d, "document_entities"))


@query("SELECT (SELECT count(*) FROM rag_documents) AS documents, (SELECT count(*) FROM document_paragraphs) AS paragraphs, (SELECT count(*) FROM document_parent_chunks) AS parents")
def totals(s, d):
    return inv.totals({"documents": _docs(s, d), "paragraphs": table(s, d, "document_paragraphs"), "parents": table(s, d, "document_parent_chunks")})


@query(f"WITH {P} SELECT CASE WHEN parent_chunk_id IS NULL THEN 'null' ELSE 'value' END AS status, count(*) AS n FROM p GROUP BY ALL")
def null_distribution(s, d):
    return inv.null_distribution(_paras(s, d, "parent_chunk_id"), "parent_chunk_id")


GONE = "g AS (SELECT id FROM rag_documents WHERE metadata.fuente = 'gaceta')"


@query(f"WITH {P}, {GONE} SELECT 'rag_documents' AS name, count(*) AS n FROM rag_documents WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT 'document_paragraphs', count(*) FROM p WHERE document_id NOT IN (SELECT id FROM g) UNION ALL SELECT 'document_parent_chunks', count(*) FROM document_parent_chunks WHERE document_id NOT IN (SELECT id FROM g) UNION ALL SELECT 'document_entities', count(*) FROM document_entities WHERE document_id NOT IN (SELECT id FROM g)")
def cascade_delete(s, d):
    tables = {"rag_documents": _docs(s, d).select("id", "metadata"), "document_paragraphs": _paras(s, d, "document_id", "parent_chunk_id"), "document_parent_chunks": table(s, d, "document_parent_chunks").select("id", "document_id"), "document_entities": table(s, d, "document_entities").select("id", "document_id")}
    left = inv.delete_documents(tables, _docs(s, d).filter("metadata.fuente = 'gaceta'").select("id"))
    out = None
    for name, df in left.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT id, document_id, lower(trim(entity_name)) AS key FROM document_entities WHERE trim(entity_name) != '' QUALIFY row_number() OVER (PARTITION BY document_id, lower(trim(entity_name)) ORDER BY id) = 1")
def entity_dedup(s, d):
    return inv.unique_entities(table(s, d, "document_entities")).select("id", "document_id", "key")


@query(
    "WITH k AS (SELECT id, min(id) OVER (PARTITION BY document_id, lower(trim(entity_name))) AS first_id FROM document_entities WHERE trim(entity_name) != '') "
    "SELECT s.first_id AS source_id, t.first_id AS target_id, lower(trim(relation_type)) AS relation_type, count(*) AS n FROM entity_relations r JOIN k s ON s.id = r.source_entity_id JOIN k t ON t.id = r.target_entity_id GROUP BY ALL"
)
def relation_merge(s, d):
    return inv.merged_relations(table(s, d, "entity_relations"), table(s, d, "document_entities"))


# --- graph ------------------------------------------------------------------------------------------------------------------


def _doc_vectors(s, d):
    return _docs(s, d).select("id", F.col("metadata.fuente").alias("document_id"), F.col("embedding_base").alias("embedding"))


_REL = (
    f"WITH r AS (SELECT a.id AS source_id, b.id AS target_id, round({_cos('a.embedding_base::DOUBLE[]', 'b.embedding_base::DOUBLE[]')}, 6) AS similarity FROM rag_documents a JOIN rag_documents b ON a.id < b.id {{0}}) "
    "SELECT * FROM r WHERE similarity >= 0.3 ORDER BY similarity DESC, source_id, target_id LIMIT 400"
)


@query(_REL.format(""))
def relations_pairs(s, d):
    return gr.relations(_doc_vectors(s, d), 0.3)


@query(_REL.format("AND a.metadata.fuente != b.metadata.fuente"))
def relations_cross_doc(s, d):
    return gr.relations(_doc_vectors(s, d), 0.3, cross_doc=True)


@query(f"WITH c AS (SELECT id, embedding_base::DOUBLE[] AS v FROM rag_documents WHERE id = (SELECT min(id) FROM rag_documents)), r AS (SELECT c.id AS source_id, b.id AS target_id, round({_cos('b.embedding_base::DOUBLE[]', 'c.v')}, 6) AS similarity FROM rag_documents b, c WHERE b.id <> c.id) SELECT * FROM r WHERE similarity >= 0.1 ORDER BY similarity DESC, target_id LIMIT 400")
def relations_ego(s, d):
    return gr.ego(_doc_vectors(s, d), _docs(s, d).agg(F.min("id")).first()[0], 0.1)


@query(
    f"WITH r AS ({_REL.format('')}) SELECT source_id AS id, target_id AS neighbour_id, similarity, CASE WHEN similarity > 0.82 THEN 'high' ELSE 'normal' END AS strength FROM r UNION ALL SELECT target_id, source_id, similarity, CASE WHEN similarity > 0.82 THEN 'high' ELSE 'normal' END FROM r"
)
def neighbour_list(s, d):
    return gr.neighbour_list(relations_pairs(s, d))


@query(f"WITH {P} SELECT 'doc-' || id AS node_id, CASE WHEN length(title) > 22 THEN substr(title, 1, 22) || '…' ELSE title END AS label, 'doc' AS kind, id AS document_id FROM rag_documents UNION ALL SELECT 'frag-' || id, 'F' || (paragraph_index + 1), 'frag', document_id FROM p")
def graph_nodes(s, d):
    return gr.nodes(_docs(s, d), _paras(s, d, "document_id", "paragraph_index"))


EDGES = f"WITH {P}, n AS (SELECT id, document_id, lag(id) OVER (PARTITION BY document_id ORDER BY paragraph_index, id) AS before FROM p), g AS (SELECT 'doc-' || document_id AS from_id, 'frag-' || id AS to_id, 'hierarchy' AS kind FROM p UNION ALL SELECT 'frag-' || before, 'frag-' || id, 'sequential' FROM n WHERE before IS NOT NULL)"


@query(f"{EDGES} SELECT * FROM g")
def graph_edges(s, d):
    return gr.edges(_paras(s, d, "document_id", "paragraph_index"))


HEAT = f"{Q}, {_vec(1000)}, m AS (SELECT query_id, id, round(greatest(0.0::DOUBLE, 1 - distance / 2), 7) AS score FROM v), z AS (SELECT query_id, min(score) AS lo, max(score) AS hi FROM m GROUP BY query_id), t AS (SELECT m.query_id, id, score, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END, 6) AS normalized FROM m JOIN z USING (query_id))"


@query(f"WITH {P}, {HEAT} SELECT query_id, id, score, normalized, (score > 0.05 AND normalized > 0.6) AS relevant FROM t")
def graph_heat(s, d):
    return gr.heat(score_map(s, d).select("query_id", "id", "score"))


@query(f"{EDGES}, {HEAT}, o AS (SELECT DISTINCT 'frag-' || id AS node FROM t WHERE normalized > 0.6 AND query_id = (SELECT min(query_id) FROM q)) SELECT g.*, g.to_id IN (SELECT node FROM o) AS visible FROM g")
def edge_visibility(s, d):
    q = _queries(s, d)
    first = q.join(F.broadcast(q.agg(F.min("query_id").alias("query_id"))), "query_id", "left_semi")  # the heat of one query is shown
    heated = gr.heat(rt.score_map(_chunks(s, d), first).select("query_id", "id", "score"))
    return gr.visible_edges(graph_edges(s, d), heated)


@query("SELECT id, round((row_number() OVER (ORDER BY created_at, id) - 1) * 360.0::DOUBLE / count(*) OVER () % 360, 4) AS hue FROM rag_documents")
def graph_hues(s, d):
    return gr.hues(_docs(s, d))


@query(f"WITH {P} SELECT 'frag-' || p.id AS key, d.title || ' · frag. ' || (p.paragraph_index + 1) AS label FROM p JOIN rag_documents d ON d.id = p.document_id")
def citation_labels(s, d):
    rows = _paras(s, d, "document_id", "paragraph_index").join(_docs(s, d).select(F.col("id").alias("document_id"), "title"), "document_id")
    return rows.select(F.concat(F.lit("frag-"), "id").alias("key"), F.concat("title", F.lit(" · frag. "), (F.col("paragraph_index") + 1).cast("string")).alias("label"))


# --- text -------------------------------------------------------------------------------------------------------------------

TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


@query(
    f"SELECT id, row_number() OVER (PARTITION BY id ORDER BY no) - 1 AS n, paragraph FROM (SELECT id, no, paragraph FROM (SELECT id, generate_subscripts(parts, 1) AS no, unnest(parts) AS paragraph FROM (SELECT id, list_transform(regexp_split_to_array(content, '\\n\\s*\\n'), lambda x: {TRIM.format('x')}) AS parts FROM rag_documents)) WHERE length(paragraph) >= 20 AND NOT regexp_matches(paragraph, '^#{{1,6}}\\s'))"
)
def paragraph_split(s, d):
    return _docs(s, d).select("id", F.posexplode(tx.paragraphs(F.col("content"))).alias("n", "paragraph")).select("id", F.col("n").cast("long").alias("n"), "paragraph")


@query("SELECT id, CASE WHEN length(content) <= 500 THEN content ELSE regexp_replace(substr(content, 1, 500), '\\s+\\S*$', '') || '...' END AS summary FROM rag_documents")
def summary_cut(s, d):
    return _docs(s, d).select("id", tx.summary(F.col("content")).alias("summary"))


@query(f"WITH {P} SELECT p.id, 'Documento: ' || d.title || CASE WHEN coalesce(p.metadata.context_path, '') != '' THEN chr(10) || 'Contexto normativo: ' || p.metadata.context_path || chr(10) ELSE '' END || chr(10) || p.raw_content AS t FROM p JOIN rag_documents d ON d.id = p.document_id")
def context_text(s, d):
    rows = _paras(s, d, "document_id", "metadata", "raw_content").join(_docs(s, d).select(F.col("id").alias("document_id"), "title"), "document_id")
    return rows.select("id", tx.context_text(F.col("title"), F.col("metadata.context_path"), F.col("raw_content")).alias("t"))


@query(
    "WITH m AS (SELECT doc_id, '<?xml version=\"1.0\"?><d><s>' || source || '</s> <t><![CDATA[' || text || ']]></t><!-- x --></d>' AS x FROM documents), "
    "c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<\\?xml[^>]*\\?>', '', 'g'), '<!\\[CDATA\\[', '', 'g'), '\\]\\]>', '', 'g'), '<!--(?s:.)*?-->', '', 'g') AS x FROM m) "
    f"SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(x, '</?[^>]+>'), lambda y: {TRIM.format('y')}), lambda y: y != ''), chr(10)) AS content FROM c"
)
def markup_strip(s, d):
    xml = F.concat(F.lit('<?xml version="1.0"?><d><s>'), "source", F.lit("</s> <t><![CDATA["), "text", F.lit("]]></t><!-- x --></d>"))
    return table(s, d, "documents").select("doc_id", tx.strip_markup(xml).alias("content"))


_STEM_SUM = " + ".join(f"len(regexp_extract_all(c, '(?:^|[^A-Za-z0-9_]){stem}'))" for stem in tx.LEGAL_STEMS)
_PHRASE_SUM = " + ".join(f"CASE WHEN contains(c, '{p}') THEN 3 ELSE 0 END" for p in tx.LEGAL_PHRASES)


@query(
    "WITH a AS (SELECT id, lower(content) AS c FROM rag_documents), b AS (SELECT id, c, length(regexp_replace(c, '\\s+', '', 'g')) AS n, list_filter(string_split(c, chr(10)), lambda x: regexp_replace(x, '\\s+', '', 'g') != '') AS ls FROM a) "
    f"SELECT id, round(({_STEM_SUM} + {_PHRASE_SUM}) * 5.0::DOUBLE / greatest(n / 1000.0::DOUBLE, 1.0::DOUBLE) + len(list_filter(ls, lambda x: regexp_matches(x, '^\\s*(?:[0-9]{{1,3}}[.)]|[ivxlcdm]+[.)]|art(?:ículo|iculo)?\\.?\\s*[0-9]+)'))) / len(ls) * 30.0::DOUBLE, 2) AS score, CASE WHEN score >= 14 THEN 'legal' ELSE 'generic' END AS strategy FROM b"
)
def strategy_score(s, d):
    rows = _docs(s, d).select("id", tx.strategy_score(F.col("content")).alias("score"))
    return rows.withColumn("strategy", tx.strategy(F.col("score")))


def _duck_says(wording: str) -> str:
    return f"regexp_matches(t, '(?i){wording}')"


@query(f"WITH {E}, z AS (SELECT id, trim(query_text) AS t FROM e) SELECT id, CASE WHEN t = '' THEN 'ask' WHEN {_duck_says(tx.LIST_WORDING)} THEN 'list_docs' WHEN {_duck_says(tx.CONTENT_WORDING)} THEN 'rag' WHEN {_duck_says(tx.CHAT_WORDING)} THEN 'chat' ELSE 'ask' END AS intent FROM z")
def intent_class(s, d):
    return _evals(s, d).select("id", tx.intent(F.col("query_text")).alias("intent"))


@query(
    f"WITH {E}, a AS (SELECT id, list_filter(list_transform(regexp_split_to_array(regexp_replace(query_text, '(^|[^A-Za-z0-9_])(?:y/o|y|o)\\s', '\\1,', 'gi'), '\\s*[,;]\\s*'), lambda x: trim(regexp_replace(trim(x), '^(?:art[ií]culos?\\s+que\\s+hablen\\s+(?:sobre|de)\\s+|que\\s+hablen\\s+(?:sobre|de)\\s+|sobre\\s+|acerca\\s+de\\s+|b[uú]squeda\\s+de\\s+|buscar\\s+|info\\s+(?:sobre\\s+)?)', '', 'i'))), lambda x: length(x) >= 4) AS f FROM e) "
    "SELECT id, CASE WHEN len(f) >= 2 THEN array_to_string(f[1:5], '|') END AS facets FROM a"
)
def facet_split(s, d):
    return _evals(s, d).select("id", F.array_join(tx.facets(F.col("query_text")), "|").alias("facets"))


@query(f"WITH {E} SELECT id, regexp_matches(query_text, '(?i)\\s(?:y|e|ni|o)\\s|\\sy/o\\s|además|también|así como|,\\s*|;\\s*|\\?\\s*\\?') AS split FROM e")
def decompose_guard(s, d):
    return _evals(s, d).select("id", tx.may_need_split(F.col("query_text")).alias("split"))


@query(f"WITH {E} SELECT id, array_to_string({TERMS.format('query_text')}, ' | ') AS terms, nullif(regexp_extract(query_text, '(?i)art(?:ículo|iculo)?\\.?\\s*([0-9]+)', 1), '') AS article FROM e")
def query_terms(s, d):
    return _evals(s, d).select("id", F.array_join(tx.query_terms(F.col("query_text")), " | ").alias("terms"), tx.article_number(F.col("query_text")).alias("article"))


@query("SELECT id, 'documents/' || (epoch_us(created_at) // 1000) || '-' || regexp_replace(title, '[\\\\/:*?\"<>|]', '_', 'g') AS key FROM rag_documents")
def storage_keys(s, d):
    from ..sources.files import storage_key

    return _docs(s, d).select("id", storage_key(F.col("created_at"), F.col("title")).alias("key"))


LINES = "ln AS (SELECT id, no, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start FROM (SELECT id, generate_subscripts(ls, 1) AS no, unnest(ls) AS line FROM (SELECT id, string_split(content, chr(10)) AS ls FROM rag_documents)))"


@query(f"WITH {LINES} SELECT id AS document_id, no::INT AS line_no, start, line FROM ln")
def line_offsets(s, d):
    return ck.lines(_docs(s, d))




#: The levels once more, as DuckDB reads them.
_LEVEL_SQL = (
    ("ley", 1, "(?:ley|decreto-ley)\\s+(?:n[°º]\\.?\\s*)?([0-9]+(?:\\.[0-9]+)*|[ivxlcdm]+)"),
    ("decreto", 2, "decreto\\s+(?:n[°º]\\.?\\s*)?([0-9]+(?:\\.[0-9]+)*|[ivxlcdm]+)"),
    ("titulo", 3, "t[ií]tulo\\s+([ivxlcdm]+|[0-9]+)"),
    ("capitulo", 4, "(?:cap[ií]tulo|cap\\.)\\s+([ivxlcdm]+|[0-9]+)"),
    ("seccion", 5, "secci[oó]n\\s+([ivxlcdm]+|[0-9]+)"),
    ("seccion", 5, "disposicion(?:es|e)()"),
    ("anexo", 6, "anexo\\s+([ivxlcdm]+|[0-9]+|[a-zà-ÿ]{1,3})(?:[\\s.:-]|$)"),
    ("articulo", 6, "art(?:[ií]culo)?\\.?\\s+([0-9]+)"),
    ("inciso", 7, "(?:inciso|numeral)\\s+([a-z0-9]+)"),
)


def _outline_sql() -> str:
    when = "WHEN regexp_matches(lower(line), '^{}') THEN "
    level = " ".join(when.format(p) + f"'{name}'" for name, _, p in _LEVEL_SQL)
    rank = " ".join(when.format(p) + str(number) for _, number, p in _LEVEL_SQL)
    label = " ".join(when.format(p) + f"trim('{name.upper()} ' || upper(regexp_extract(lower(line), '^{p}', 1)))" for name, _, p in _LEVEL_SQL)
    return f"on_ AS (SELECT id, start, CASE {level} END AS level, CASE {rank} END AS rank, CASE {label} END AS label FROM ln)"


@query(f"WITH {LINES}, {_outline_sql()} SELECT id AS document_id, start, level, rank, label FROM on_ WHERE level IS NOT NULL")
def outline_nodes(s, d):
    return ck.outline_table(_docs(s, d))


def _paths_sql() -> str:
    last = ", ".join(f"max(CASE WHEN n.rank = {r} THEN n.start END) AS s{r}" for r in range(1, 8))
    named = ", ".join(f"max_by(n.label, n.start) FILTER (WHERE n.rank = {r}) AS l{r}" for r in range(1, 8))
    parts = []
    for r in range(1, 8):
        above = "greatest(-1, " + ", ".join(f"coalesce(s{q}, -1)" for q in range(1, r)) + ")" if r > 1 else "-1"
        parts.append(f"CASE WHEN s{r} > {above} THEN l{r} END")
    return f"pl AS (SELECT DISTINCT id, start AS place FROM ln), ag AS (SELECT pl.id, pl.place, {last}, {named} FROM pl LEFT JOIN (SELECT * FROM on_ WHERE level IS NOT NULL) n ON n.id = pl.id AND n.start <= pl.place GROUP BY pl.id, pl.place) SELECT id AS document_id, place, concat_ws(' > ', {', '.join(parts)}) AS context_path FROM ag"


@query(f"WITH {LINES}, {_outline_sql()}, {_paths_sql()}")
def outline_paths(s, d):
    """As-of lookup of the open ancestors at every line."""
    places = ck.lines(_docs(s, d)).select("document_id", F.col("start").alias("at"))
    return ck.paths_at(places, ck.outline_table(_docs(s, d))).withColumnRenamed("at", "place")


_KINDS = "CASE WHEN regexp_matches(line, '(?i)^\\s*(?:[0-9]{1,4}[.)]|[ivxlcdm]+[.)]|art(?:ículo|ÍCULO|iculo)?\\.?\\s*[0-9]+)') THEN 'numbered' WHEN regexp_matches(line, '^\\s*[a-z]{1,2}[.)]\\s') THEN 'item' WHEN regexp_matches(line, '^(?:#{1,6}\\s+|[0-9]+(?:\\.[0-9]+)*[.):]?\\s)') OR regexp_matches(line, '\\b[A-Z][A-Za-zÀ-ÿ0-9 ]{3,50}:$') THEN 'heading' WHEN regexp_matches(line, '^\\s*[-*•·]\\s+') THEN 'list' END"


@query(f"WITH {LINES} SELECT id AS document_id, start, {_KINDS} AS kind FROM ln WHERE trim(line) != '' AND ({_KINDS}) IS NOT NULL")
def boundary_lines(s, d):
    found = ck.boundary_table(_docs(s, d), kinds={"numbered", "item", "heading", "list"})
    return found.select("document_id", "start", "kind")


@query(
    f"WITH {P}, {LINES}, b AS (SELECT id, start AS pos FROM ln WHERE trim(line) != '' AND ({_KINDS}) IS NOT NULL), c AS (SELECT document_id AS id, id AS chunk, metadata.location.start_char AS start, length(raw_content) AS chars FROM p WHERE metadata.location.start_char IS NOT NULL AND document_id IN (SELECT id FROM rag_documents)), "
    "m AS (SELECT c.id, c.chunk, c.start, c.chars, min(abs(b.pos - c.start)) AS distance FROM c LEFT JOIN b ON b.id = c.id GROUP BY ALL) "
    "SELECT id AS document_id, count(*) AS chunks, round(avg(chars), 2) AS avg_chars, max(chars) AS max_chars, round(avg(distance), 2) AS avg_distance, round(avg(CASE WHEN distance <= 1 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END), 2) AS on_boundary FROM m GROUP BY id"
)
def nearest_boundary(s, d):
    """How far the stored chunks of each document begin from a boundary of its text."""
    marks = ck.boundary_table(_docs(s, d), kinds={"numbered", "item", "heading", "list"}).select("document_id", F.col("start").alias("at"))
    found = _paras(s, d, "document_id", "metadata", "raw_content").join(_docs(s, d).select(F.col("id").alias("document_id")), "document_id", "left_semi")
    pieces = found.select("document_id", F.col("metadata.location.start_char").alias("start"), F.length("raw_content").alias("chars"), "metadata.context_path").filter("start IS NOT NULL")
    return ev.chunking_report(pieces, marks).drop("with_path")


ITEMS = "it AS (SELECT id, (no - 1) // 10 AS page, ((no - 1) % 10) / 10.0::DOUBLE AS y, line AS str FROM ln WHERE trim(line) != '')"


def _items(s, d):
    """Page items made of the documents' lines: ten lines a page, one item a line."""
    ls = ck.lines(_docs(s, d)).filter(F.trim("line") != "")
    no = F.col("line_no") - 1
    return ls.select("document_id", F.floor(no / 10).cast("int").alias("page"), F.col("line_no").cast("int").alias("item"), F.col("line").alias("str"), F.lit(0.0).alias("x"), ((no % 10) / 10.0).alias("y"), F.lit(0.9).alias("width"), F.lit(0.08).alias("height"))


@query(f"WITH {LINES}, {ITEMS}, k AS (SELECT DISTINCT id, page, trim(regexp_replace(lower(str), '\\s+', ' ', 'g')) AS key FROM it WHERE y + 0.08 <= 0.12 OR y >= 0.88) SELECT id AS document_id, key FROM k WHERE key != '' GROUP BY ALL HAVING count(*) >= 3")
def layout_repeats(s, d):
    return ly.repeated_rows(ly.row_table(ly.page_rows(_items(s, d))))


@query(
    f"WITH {LINES}, {ITEMS}, k AS (SELECT DISTINCT id, page, trim(regexp_replace(lower(str), '\\s+', ' ', 'g')) AS key FROM it WHERE y + 0.08 <= 0.12 OR y >= 0.88), r AS (SELECT id, key FROM k WHERE key != '' GROUP BY ALL HAVING count(*) >= 3), "
    "t AS (SELECT it.id, page, string_agg(str || chr(10), '' ORDER BY y) AS text FROM it LEFT JOIN r ON r.id = it.id AND r.key = trim(regexp_replace(lower(str), '\\s+', ' ', 'g')) WHERE r.key IS NULL GROUP BY ALL) "
    "SELECT id AS document_id, string_agg(regexp_replace(text, '\\s+$', ''), chr(10) || chr(10) ORDER BY page) AS text FROM t GROUP BY id"
)
def layout_flat_text(s, d):
    return ly.flat_text(ly.page_texts(_items(s, d)))


@query(
    f"WITH {LINES}, {ITEMS}, t AS (SELECT id, page, string_agg(str || chr(10), '' ORDER BY y) AS text FROM it GROUP BY ALL), z AS (SELECT id, page, length(regexp_replace(text, '\\s+$', '')) AS n FROM t), "
    "sp AS (SELECT id, page, coalesce(sum(n + 2) OVER (PARTITION BY id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS p0, n FROM z), c AS (SELECT id, i AS chunk_id, i * 700 AS a, i * 700 + 900 AS b FROM (SELECT id, unnest(range((length(content) + 699) // 700)) AS i FROM rag_documents)) "
    "SELECT sp.id AS document_id, chunk_id::INT AS chunk_id, page::INT AS page, (greatest(a, p0) - p0)::BIGINT AS local_start, (least(b, p0 + n) - p0)::BIGINT AS local_end FROM c JOIN sp ON sp.id = c.id WHERE a < p0 + n AND b > p0"
)
def chunk_pages(s, d):
    """Windows of 900 characters, one every 700, over the whole length of each text, on the pages they touch."""
    last = F.floor((F.length("content") - 1) / 700).cast("int")
    chunks = _docs(s, d).filter("content != ''").select(F.col("id").alias("document_id"), F.explode(F.sequence(F.lit(0), last)).alias("chunk_id"))
    chunks = chunks.select("document_id", "chunk_id", (F.col("chunk_id") * 700).cast("long").alias("start"), (F.col("chunk_id") * 700 + 900).cast("long").alias("end"))
    return ly.pages_of_chunks(chunks, ly.page_texts(_items(s, d), sanitize=False))


@query(f"WITH {LINES} SELECT id AS document_id, sum((length(lower(line)) - length(replace(lower(line), 'multa', ''))) // 5)::BIGINT AS n FROM ln GROUP BY id HAVING n > 0")
def find_in_doc(s, d):
    found = ly.occurrences(ck.lines(_docs(s, d)), "multa")
    return found.groupBy("document_id").agg(F.count("*").alias("n"))


# --- memory -----------------------------------------------------------------------------------------------------------------


def _messages(s, d):
    """Sessions made of the evaluations: one a channel and day, each question and its answer in turn."""
    e = _evals(s, d).select("channel", "created_at", "id", "query_text", "answer_text")
    session = F.concat_ws("/", "channel", F.date_format("created_at", "yyyy-MM-dd"))
    n = F.row_number().over(Window.partitionBy(session).orderBy("created_at", "id"))
    numbered = e.select(session.alias("session_id"), n.alias("n"), "query_text", "answer_text")
    turns = numbered.select("session_id", "n", F.explode(F.array(F.struct(F.lit(0).alias("o"), F.lit("user").alias("role"), F.col("query_text").alias("content")), F.struct(F.lit(1).alias("o"), F.lit("function").alias("role"), F.col("answer_text").alias("content")))).alias("m"))
    return turns.select("session_id", (F.col("n") * 2 + F.col("m.o")).alias("no"), F.col("m.role").alias("role"), F.col("m.content").alias("content"))


MESSAGES = f"{E}, tn AS (SELECT channel || '/' || strftime(created_at, '%Y-%m-%d') AS session_id, row_number() OVER (PARTITION BY channel || '/' || strftime(created_at, '%Y-%m-%d') ORDER BY created_at, id) AS n, query_text, answer_text FROM e), ms AS (SELECT session_id, n * 2 AS no, 'user' AS role, query_text AS content FROM tn UNION ALL SELECT session_id, n * 2 + 1, 'function', answer_text FROM tn)"


@query(f"WITH {MESSAGES} SELECT session_id, string_agg(upper(role) || ': ' || content, chr(10) ORDER BY no) AS history FROM ms GROUP BY session_id")
def history_text(s, d):
    return mem.history_text(_messages(s, d))


@query(f"WITH {MESSAGES}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY no) AS place, count(*) OVER (PARTITION BY session_id) AS n FROM ms) SELECT session_id, no::INT AS no, CASE WHEN role = 'function' THEN 'assistant' ELSE role END AS role, content FROM r WHERE NOT (n > 4 AND place <= floor(n / 2)) UNION ALL SELECT session_id, -2, 'system', string_agg(upper(role) || ': ' || content, chr(10) ORDER BY no) FROM r WHERE n > 4 AND place <= floor(n / 2) GROUP BY session_id")
def rollover_keep(s, d):
    kept, past = mem.rolled(_messages(s, d), max_turns=2)
    return mem.for_model(kept, past)


# --- chunking (no SQL) ------------------------------------------------------------------------------------------------------


@query()
def chunk_documents(s, d):
    return ck.chunk_documents(_docs(s, d).select("id", "content", "mime_type"))


@query("SELECT id, TRUE AS whole FROM rag_documents")
def chunk_cover(s, d):
    """Whether the children of each document hold its text: equal without white space and hyphens of broken words."""
    bare = F.regexp_replace("text", r"[\s-]+", "")
    pieces = ck.chunk_documents(_docs(s, d).select("id", "content", "mime_type"), mime=None).filter("kind = 'child'")
    joined = pieces.groupBy(F.col("document_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_index", bare.alias("t")))), lambda x: x["t"]), "").alias("t"))
    return _docs(s, d).select("id", F.regexp_replace("content", r"[\s-]+", "").alias("c")).join(joined, "id", "left").select("id", (F.col("c") == F.col("t")).alias("whole"))


@query()
def streamed_windows(s, d):
    """Counts of events in windows of five minutes, by the plan that the stream runs."""
    from ..streaming.ingest import event_windows

    return event_windows(table(s, d, "events"))
