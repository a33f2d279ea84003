import pathlib
import re
import time

import pytest
from pyspark.sql import functions as F

from tesela.functions.models import embedder, hashed_vector, persistent, wait_before
from tesela.plans import conversation as cv

from .test_operators import chunks, docs, parents  # noqa: F401


def test_routes(spark):
    asked = spark.createDataFrame([("a", "hola"), ("b", "listame los documentos"), ("c", "qué dice el artículo 2"), ("d", "algo raro"), ("e", "otra cosa"), ("f", "nada")], "query_id string, query_text string")
    decided = spark.createDataFrame([("d", "CHAT", ""), ("e", "desconocido", "multa"), ("c", "chat", "x")], "query_id string, intent string, query string")
    got = {r.query_id: (r.intent, r.query_text) for r in cv.routed(asked, decided).collect()}
    assert [got[k][0] for k in "abcdef"] == ["chat", "list_docs", "rag", "chat", "rag", "rag"]
    assert got["e"][1] == "multa" and got["c"][1] == "qué dice el artículo 2"
    assert {r.intent for r in cv.routed(asked).filter("query_id > 'c'").collect()} == {"rag"}


def test_replies_and_memory(spark, chunks, docs, parents):  # noqa: F811
    full = docs.withColumn("mime_type", F.lit("x")).withColumn("created_at", F.current_timestamp())
    tables = {"document_paragraphs": chunks, "rag_documents": full, "document_parent_chunks": parents}
    asked = spark.createDataFrame([("a", "hola"), ("b", "inventario"), ("c", "multa artículo 2")], "query_id string, query_text string")
    out = cv.replies(asked, tables, embedder(dims=8))
    assert {r.query_id for r in out["sources"].collect()} == {"c"} and {r.query_id for r in out["talk"].collect()} == {"a"}
    assert out["inventory"].count() == 3
    m = spark.createDataFrame([("s", 4, "user", "x")], "session_id string, no int, role string, content string")
    turns = spark.createDataFrame([("s", "uno", "dos"), ("t", "tres", None)], "session_id string, query_text string, answer string")
    assert sorted((r.session_id, r.no, r.role) for r in cv.remembered(m, turns).collect()) == [("s", 4, "user"), ("s", 5, "user"), ("s", 6, "assistant"), ("t", 1, "user")]


def test_time_budget(spark):
    assert cv.within(spark, 30, lambda: spark.range(5).count()) == 5
    began = time.time()
    with pytest.raises(TimeoutError):
        cv.within(spark, 1, lambda: spark.range(0, 10**13, 1, 4).selectExpr("sum(id % 7)").collect())
    assert time.time() - began < 20
    with pytest.raises(ZeroDivisionError):
        cv.within(spark, 5, lambda: 1 / 0)


def test_retries():
    calls = []

    def flaky(batch):
        calls.append(1)
        if len(calls) < 3:
            raise ValueError("no")
        return batch

    assert persistent(flaky, 3, base=0.0)([1]) == [1]
    with pytest.raises(ValueError):
        calls.clear()
        persistent(flaky, 2, base=0.0)([1])
    limited = ValueError("429")
    assert wait_before(1, limited) == 10.0 and wait_before(3, ValueError("x")) == 4.0
    limited.headers = {"Retry-After": "7"}
    assert wait_before(1, limited) == 7.0
    assert len(hashed_vector("a", 8)) == 8


def test_nothing_outside_imports_the_text_package():
    root = pathlib.Path(__file__).resolve().parents[1] / "tesela"
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"(?:from|import)\s+[\w.]*\bllm\b", f.read_text()), f
