"""Operators that SQL doesn't show: loops, layout, memory, models, sources, streams, maintenance."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tesela.functions.models import embedder, hashed_vector, reranker
from tesela.operators import chunk as ck
from tesela.operators import context as cx
from tesela.operators import graph as gr
from tesela.operators import inventory as inv
from tesela.operators import layout as ly
from tesela.operators import memory as mem
from tesela.operators import retrieve as rt
from tesela.operators.ordering import positions
from tesela.plans import engine
from tesela.session import table
from tesela.sources import files
from tesela.streaming import ingest


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(f"c{d}{i}", f"d{d}", i, f"texto {d} {i} multa" if i % 2 else f"texto {d} {i} artículo {i}", f"ctx {d} {i}", hashed_vector(f"texto {d} {i}", 8), f"p{d}{i // 2}") for d in range(3) for i in range(6)]
    return spark.createDataFrame(rows, "id string, document_id string, paragraph_index int, raw_content string, contextualized_text string, embedding array<double>, parent_chunk_id string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(f"d{d}", f"Ley {d}", "k", None, hashed_vector(f"ley {d}", 8)) for d in range(3)], "id string, title string, r2_key string, r2_url string, embedding_base array<double>")


@pytest.fixture(scope="module")
def parents(spark):
    return spark.createDataFrame([(f"p{d}{i}", f"d{d}", f"padre {d} {i}") for d in range(3) for i in range(3)], "id string, document_id string, content string")


def queries(spark, text="multa artículo 2", n=1):
    return spark.createDataFrame([(f"q{i}", text, hashed_vector(text, 8)) for i in range(n)], "query_id string, query_text string, query_vector array<double>")


def test_rank_fusion_by_hand(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "query_id string, id string, rank int")
    b = spark.createDataFrame([("q", "y", 1)], "query_id string, id string, rank int")
    got = {r.id: r.rrf for r in rt.fuse([(a, 0.6), (b, 0.4)]).collect()}
    assert got["x"] == pytest.approx(0.6 / 61) and got["y"] == pytest.approx(0.6 / 62 + 0.4 / 61)


def test_exact_reference_comes_first_and_can_be_added(spark, chunks, docs):
    q = queries(spark, "artículo 4")
    top = rt.hybrid_search(chunks, docs, q).orderBy("rank").first()
    assert "artículo 4" in top.raw_content and top.hybrid_score > 0.5
    o = rt.Options(limit=1, candidate_multiplier=1)
    with_all = rt.hybrid_ranking(chunks, q, rt.Options(limit=20, candidate_multiplier=1, include_exact=True))
    assert with_all.count() >= rt.hybrid_ranking(chunks, q, o).count()


def test_document_filter_and_no_filter(spark, chunks, docs):
    q = queries(spark)
    assert {r.document_id for r in rt.hybrid_search(chunks, docs, q, doc_ids=["d1"]).collect()} == {"d1"}
    assert rt.hybrid_search(chunks, docs, q, doc_ids=[]).count() == rt.hybrid_search(chunks, docs, q).count()


def test_large_query_sets_go_in_blocks(spark, chunks, monkeypatch):
    q = queries(spark, n=3)
    want = sorted(map(tuple, rt.vector_ranking(chunks, q, 4).collect()))
    monkeypatch.setattr(rt, "QUERY_BYTES", 0)
    assert sorted(map(tuple, rt.vector_ranking(chunks, q, 4).collect())) == want


def test_few_candidates_pass_through_unscored(spark, chunks, docs):
    found = rt.hybrid_search(chunks, docs, queries(spark), rt.Options(limit=3))
    kept = cx.rerank(found, 7, F.lit(0.9)).orderBy("final_rank").collect()
    assert [r.rerank_score for r in kept] == [None] * 3 and [r.rank for r in kept] == [1, 2, 3]


def test_cross_encoder(spark, chunks, docs):
    found = rt.hybrid_search(chunks, docs, queries(spark)).withColumn("query_text", F.lit("texto 2 3 multa"))
    best = cx.cross_encoded(found, reranker(), 2).orderBy("final_rank").first()
    assert best.raw_content == "texto 2 3 multa"


def test_whole_request_in_one_plan(spark, chunks, docs, parents):
    tables = {"document_paragraphs": chunks, "rag_documents": docs, "document_parent_chunks": parents}
    asked = spark.createDataFrame([("a", "multa, artículo 2"), ("b", "texto")], "query_id string, query_text string")
    got = engine.answer_sources(asked, tables, embedder(dims=8))
    rows = got.collect()
    assert {r.query_id for r in rows} == {"a", "b"} and all(r.parent_content.startswith("padre") for r in rows)
    assert engine.contexts(got).count() == 2
    assert engine.simple_sources(queries(spark), tables).count() == 7
    assert cx.with_parents(chunks, parents, enabled=False).filter("parent_content IS NOT NULL").count() == 0


def test_expansion_stops(spark, chunks, docs):
    start = rt.hybrid_search(chunks, docs, queries(spark), rt.Options(limit=1)).select("query_id", "id", "document_id", "paragraph_index", "doc_title", "rank")
    ask = lambda cur: spark.createDataFrame([("r1", "Ley 0", 2, "after", 2)], "request_id string, doc string, paragraph_index int, direction string, count int")
    grown, used = cx.expand_context(start, chunks, docs, ask)
    assert used <= 4 and grown.count() >= 1
    same, used = cx.expand_context(start, chunks, docs, lambda cur: None)
    assert used == 1 and same.count() == 1


def test_corrective_passes_put_new_sources_first(spark, chunks, docs):
    base = rt.hybrid_search(chunks, docs, queries(spark, "multa"), rt.Options(limit=2)).select("query_id", "id", "document_id", "paragraph_index", "rank")
    fresh = base.sparkSession.createDataFrame([("q0", "c25", "d2", 5, 1)], base.schema)
    merged, decision = cx.corrective_passes(base, lambda s: ("AMBIGUOUS", "otra"), lambda q: fresh, 1)
    assert decision == "AMBIGUOUS" and merged.orderBy("rank").first().id == "c25"
    same, decision = cx.corrective_passes(base, lambda s: ("RELEVANT", None), lambda q: fresh, 3)
    assert decision == "RELEVANT" and same is base


def test_layout(spark):
    items = []
    for p in range(1, 5):
        items += [("d", p, 0, "Gaceta", 0.1, 0.05, 0.2, 0.02), ("d", p, 1, "cuerpo", 0.1, 0.5, 0.1, 0.02), ("d", p, 2, f"n{p}", 0.25, 0.501, 0.1, 0.02), ("d", p, 3, f"{p}", 0.5, 0.95, 0.1, 0.02)]
    df = spark.createDataFrame(items, "document_id string, page int, item int, str string, x double, y double, width double, height double")
    pages = {r.page: r.text for r in ly.page_texts(df).collect()}
    assert pages[2] == "cuerpo n2\n2\n"  # the header stands on four pages, the numbers differ
    assert ly.page_texts(df.filter("page < 3")).filter("text LIKE 'Gaceta%'").count() == 2
    flat = ly.flat_text(ly.page_texts(df)).first().text
    assert flat.startswith("cuerpo n1\n1\n\ncuerpo n2")
    spans = ly.page_spans(ly.page_texts(df)).orderBy("page").collect()
    assert all(flat[s.start : s.end].startswith(f"cuerpo n{s.page}") for s in spans)
    assert ly.cluster([0.1, 0.105, 0.3], [0.12, 0.125, 0.32]) == [0, 0, 1]
    boxes = ly.row_boxes(ly.page_rows(df), ["document_id", "page"])
    assert boxes.filter("page = 1").count() == 3


def test_locating_by_content(spark):
    pages = spark.createDataFrame([("d", 1, "uno dos\ntres"), ("d", 2, "cuatro  cinco")], "document_id string, page int, text string")
    chunks = spark.createDataFrame([("d", "c", "dos tres\nno está\ncuatro cinco")], "document_id string, chunk_id string, text string")
    assert [(r.page, r.start, r.end) for r in ly.locate_by_content(chunks, pages).collect()] == [(1, 4, 12), (2, 0, 13)]
    found = ly.occurrences(ck.lines(spark.createDataFrame([("d", "Multa y multa.\nMULTA")], "id string, content string")), "multa")
    assert sorted((r.line_no, r.at) for r in found.collect()) == [(1, 0), (1, 8), (2, 0)]
    assert spark.range(1).select(ly.needs_ocr(F.lit("  a b ")).alias("x")).first().x


def test_memory(spark):
    rows = [("s", 0, "system", "guía")] + [("s", i, "user" if i % 2 else "function", f"m{i}") for i in range(1, 8)] + [("t", 1, "user", "hola")]
    m = spark.createDataFrame(rows, "session_id string, no int, role string, content string")
    kept, past = mem.rolled(m, 2)
    assert {(r.session_id, r.no) for r in kept.collect()} == {("s", 0), ("s", 4), ("s", 5), ("s", 6), ("s", 7), ("t", 1)}
    assert past.first().summary == "USER: m1\nFUNCTION: m2\nUSER: m3"
    out = mem.for_model(kept, past).filter("session_id = 's'").orderBy("no").collect()
    assert out[0].role == "system" and {r.role for r in out} == {"system", "user", "assistant"}
    sessions = spark.createDataFrame([("u",), ("s",)], "session_id string")
    assert mem.opened(m, sessions, "hola").filter("session_id = 'u'").count() == 1
    assert mem.cleared(m, ["s"]).count() == 1


def test_failed_documents_do_not_stop_the_others(spark):
    def size_for(text):
        if "malo" in text:
            raise ValueError("x")
        return 50

    df = spark.createDataFrame([("a", "bueno " * 30, None), ("b", "malo", None), ("c", None, None), ("e", "", None)], "id string, content string, mime_type string")
    kinds = {(r.document_id, r.kind) for r in ck.chunk_documents(df, strategy="generic", size_for=size_for).collect()}
    assert kinds == {("a", "parent"), ("a", "child"), ("b", "failed")}


def test_ingest_is_repeatable(spark, sf):
    docs = table(spark, sf, "rag_documents").select("id", "title", "content", "mime_type")
    one, two = (ck.ingest_tables(docs, ck.chunk_documents(docs), embedder(dims=8)) for _ in range(2))
    for name in one:
        ids = [r.id for r in one[name].select("id").collect()]
        assert len(set(ids)) == len(ids) and set(ids) == {r.id for r in two[name].select("id").collect()}


def test_delete_sets_lost_parents_null(spark, chunks, docs, parents):
    tables = {"rag_documents": docs, "document_paragraphs": chunks, "document_parent_chunks": parents.filter("id != 'p10'")}
    out = inv.delete_documents(tables, spark.createDataFrame([("d0",)], "id string"))
    assert out["rag_documents"].count() == 2 and out["document_paragraphs"].count() == 12
    assert out["document_paragraphs"].filter("parent_chunk_id IS NULL").count() == 2


def test_relations_found_by_name(spark):
    ents = spark.createDataFrame([("1", "d", " Ana "), ("2", "d", "ana"), ("3", "d", "Río"), ("4", "d", " ")], "id string, document_id string, entity_name string")
    rel = spark.createDataFrame([("d", "ANA", "río", " Cita "), ("d", "ana", "nadie", "x")], "document_id string, source string, target string, relation_type string")
    assert [tuple(r) for r in inv.resolve_relations(rel, ents).collect()] == [("d", "1", "3", "cita")]


def test_graph_blocks_equal_one_block(spark, sf):
    v = table(spark, sf, "rag_documents").select("id", F.col("metadata.fuente").alias("document_id"), F.col("embedding_base").alias("embedding"))
    assert gr.relations(v, 0.2, block_rows=3).collect() == gr.relations(v, 0.2).collect()
    assert gr.relations(v, 0.2, limit=-5).count() == 1 and gr.relation_cap(50) == 2000 and gr.relation_cap(100) == 0
    links = gr.relations(v, 0.2)
    center = links.first().source_id
    assert gr.ego_nodes(links, center).first().id == center


def test_edges_over_runs(spark, chunks):
    want = sorted(map(tuple, gr.edges(chunks).collect()))
    assert sorted(map(tuple, gr.edges(chunks.filter("paragraph_index != 3"), run=2).filter("kind = 'sequential'").collect()))[:2] == [("frag-c00", "frag-c01", "sequential"), ("frag-c01", "frag-c02", "sequential")]
    assert sorted(map(tuple, gr.edges(chunks, run=2).collect())) == want and len(want) == 18 + 15


def test_positions(spark):
    df = spark.range(500).select(((F.col("id") * 37) % 501).alias("v"))
    got = positions(df, ["v"]).orderBy("v").collect()
    assert [r.position for r in got] == list(range(500))


def test_sources(spark, tmp_path):
    buf = io.BytesIO()
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:p><w:r><w:t>Uno</w:t></w:r></w:p><w:p><w:r><w:t>Dos</w:t></w:r></w:p></w:body></w:document>")
    (tmp_path / "a.docx").write_bytes(buf.getvalue())
    (tmp_path / "b.xml").write_text("<d><p>a</p><p>b</p></d>")
    (tmp_path / "c.txt").write_text("hola\n\n ley ")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    got = {r.path.rsplit("/", 1)[1]: (r.content, r.error) for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.docx"][0] == "Uno\n\nDos" and got["b.xml"][0] == "a\nb" and got["c.txt"][0].startswith("hola") and got["d.pdf"][1]
    assert [r.query_text for r in files.read_lines(spark, str(tmp_path / "c.txt")).collect()] == ["hola", "ley"]
    with pytest.raises(ValueError):
        files.query_table(spark, [("q", " ", [1.0])])
    path = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(path)
    files.replace_table(spark.read.parquet(path).filter("id > 0"), path)
    assert spark.read.parquet(path).count() == 2


def test_streams(spark, sf, tmp_path):
    docs = table(spark, sf, "rag_documents").select("id", "title", "content", "mime_type")
    docs.write.parquet(str(tmp_path / "in"))
    q = ingest.stream_documents(spark, str(tmp_path / "in"), "id string, title string, content string, mime_type string", str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out/document_paragraphs.parquet")).select("document_id").distinct().count() == docs.count()
    m = spark.createDataFrame([("s", i, f"m{i}") for i in range(9)], "session_id string, no int, content string")
    m.write.parquet(str(tmp_path / "msg"))
    stream = spark.readStream.schema("session_id string, no int, content string").parquet(str(tmp_path / "msg"))
    q = ingest.keep_sessions(stream, 2).writeStream.format("memory").queryName("kept").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck2")).start()
    q.awaitTermination(120)
    last = spark.table("kept").orderBy("dropped", ascending=False).first()
    assert last.kept + last.dropped == 9 and last.kept <= 4


def test_models():
    assert hashed_vector("", 4) == [0.0] * 4 and hashed_vector("ley uno", 4) == hashed_vector("LEY uno", 4)
