"""Scans by matrix products against the expressions of pairs that they stand for."""

import math

import pytest
from pyspark.sql import functions as F

from tesela.functions import text as tx
from tesela.functions import vectors as vc
from tesela.operators import retrieve as rt
from tesela.operators import scan


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def plain(rows):
    return sorted((tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in r) for r in rows), key=repr)


def vectors(spark):
    """Ties, copies, rows delivered twice, zeros, nulls, no numbers, extreme sizes, another length."""
    nan, inf = float("nan"), float("inf")
    rows = [(f"v{i:03}", [math.sin(i * 3.7 + j) for j in range(5)]) for i in range(60)]
    rows += [(f"w{i:03}", [1.0, 2.0, 0.0, 0.0, float(i % 3)]) for i in range(40)] + [(f"w{i:03}", [1.0, 2.0, 0.0, 0.0, float(i % 3)]) for i in range(9)]
    rows += [("z1", [0.0] * 5), ("z2", [0.0] * 5), ("n1", [1.0, None, 0.0, 0.0, 0.0]), ("n2", None), ("nan", [nan, 1.0, 0.0, 0.0, 0.0]), ("inf", [inf, 1.0, 0.0, 0.0, 0.0])]
    rows += [("big", [1e200, 0.0, 0.0, 0.0, 0.0]), ("tiny", [1e-170, 0.0, 0.0, 0.0, 0.0]), ("three", [1.0, 2.0, 3.0]), ("none", [])]
    return spark.createDataFrame(rows, "id string, embedding array<double>").repartition(3)


@pytest.mark.parametrize("n", [4, 30, 200])
def test_nearest_equals_the_pairs(spark, monkeypatch, n):
    chunks = vectors(spark)
    queries = chunks.filter("id LIKE 'v%5' OR id LIKE 'w00%' OR id NOT LIKE '%0%'").dropDuplicates(["id"]).select(F.concat(F.lit("q"), "id").alias("query_id"), F.col("embedding").alias("query_vector"))
    pairs = chunks.filter("embedding IS NOT NULL").crossJoin(F.broadcast(queries))
    scored = pairs.select("query_id", "id", F.round(vc.cosine_distance(F.col("embedding"), F.col("query_vector")), 6).alias("distance"))
    want = plain(rt.top_ids(scored, [F.asc_nulls_last("distance"), F.asc("id")], n).collect())
    got = rt.vector_ranking(chunks, queries, n)
    assert "NestedLoop" not in physical(got) and "Cartesian" not in physical(got)
    assert plain(got.collect()) == want
    monkeypatch.setattr(scan, "BLOCK", 3)
    monkeypatch.setattr(scan, "ROWS", 16)
    assert plain(rt.vector_ranking(chunks, queries, n).collect()) == want
    assert rt.vector_ranking(chunks, queries.limit(0), n).collect() == [] == rt.vector_ranking(chunks.limit(0), queries, n).collect()


#: Queries by name, with how often each number of an article stands beside all chunks in their plan.
WITHOUT_PAIRS = {
    "vector_topk_filtered": 0,
    "edge_visibility": 0,
    "graph_heat": 0,
    "rrf_multi_query": 0,
    "merge_dedup": 0,
    "context_assembly": 2,
    "parent_enrich": 2,
    "rerank_hybrid": 1,
    "rerank_blend": 1,
}


@pytest.mark.parametrize("name", WITHOUT_PAIRS)
def test_plans_hold_no_pairs_of_queries_and_chunks(spark, sf, name):
    from tesela import catalog

    plan = physical(catalog.QUERIES[name](spark, sf))
    assert "MapInArrow" in plan and plan.count("NestedLoopJoin") <= WITHOUT_PAIRS[name]


def test_edges_are_lit_by_the_scan_of_one_query(spark, sf, monkeypatch):
    from tesela import catalog

    met = []
    monkeypatch.setattr(scan, "nearest", lambda rows, q, *a, f=scan.nearest: met.append(q.count()) or f(rows, q, *a))
    catalog.QUERIES["edge_visibility"](spark, sf)
    assert met == [1]


@pytest.mark.parametrize("n", [2, 7, 100])
def test_counts_of_words_equal_the_pairs(spark, monkeypatch, n):
    said = ["ley uno", "ley ley multa", "Artículo 5 y multa: artículo 5", "", None, "tasa 12", "sin nada", "ÁRBOL árbol 7"]
    chunks = spark.createDataFrame([(f"c{i % 70:02}", said[i % 70 % len(said)]) for i in range(90)], "id string, raw_content string").repartition(3)
    texts = ["artículo 5 y multa", "ley", "ley, tasa 12; multa", "árbol 7", "de la", "", None, *(f"ley {i}" for i in range(10))]
    queries = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "query_id string, query_text string")
    terms = queries.select("query_id", tx.query_terms(F.col("query_text")).alias("terms")).filter(F.size("terms") > 0)
    pairs = chunks.select("id", tx.tokens(F.col("raw_content")).alias("words")).crossJoin(F.broadcast(terms)).filter(F.arrays_overlap("words", "terms"))
    scored = pairs.select("query_id", "id", F.round(tx.lexical_rank(F.col("words"), F.col("terms")), 6).alias("score"))
    want = plain(rt.top_ids(scored, [F.desc("score"), F.asc("id")], n).collect())
    got = rt.lexical_ranking(chunks, queries, n)
    assert "NestedLoop" not in physical(got) and plain(got.collect()) == want and want
    monkeypatch.setattr(scan, "BLOCK", 4)
    monkeypatch.setattr(scan, "ROWS", 8)
    assert plain(rt.lexical_ranking(chunks, queries, n).collect()) == want


def test_an_article_is_looked_for_once(spark, monkeypatch):
    said = ["según el artículo 5", "art. 55", "ART 5.", "nada", None, "artículo 7 y artículo 5"]
    chunks = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(said)], "id string, raw_content string")
    texts = ["multa artículo 5", "tasa art. 5", "artículo 7", "artículo 5", "sin número", None]
    queries = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "query_id string, query_text string")
    met = []
    monkeypatch.setattr(rt, "beside", lambda a, b, f=rt.beside: met.append(b.count()) or f(a, b))
    got = rt.article_hits(chunks, queries, 2)
    assert met == [2]  # numbers, not queries
    assert sorted(map(tuple, got.collect())) == sorted([("q2", "c5"), *((q, c) for q in ("q0", "q1", "q3") for c in ("c0", "c2"))])
