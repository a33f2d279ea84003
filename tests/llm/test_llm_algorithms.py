"""Near-duplicates, splitting and nearest vectors against brute force, and their edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesela.llm import knn, neardup, queries, split
from tesela.session import table


def jaccard_pairs(rows, n, least, threshold):
    sets = {k: frozenset(neardup.shingles(t, n, {}).tolist()) for k, t in rows.items()}
    keys = sorted(k for k, s in sets.items() if len(s) >= least)
    out = set()
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if a[0] == b[0]:
                both = len(sets[a] & sets[b])
                if both / (len(sets[a]) + len(sets[b]) - both) >= threshold:
                    out.add((a[0], a[1], b[1]))
    return out


def test_near_duplicates_equal_brute_force(spark, sf):
    rows = {}
    for name in ("rag_documents", "document_paragraphs"):
        for r in table(spark, sf, name).select("id", queries.TEXTS[name]).collect():
            rows[name, r[0]] = r[1]
    got = {tuple(r) for r in queries.p3_found(spark, sf).select("rec_table", "id_a", "id_b").collect()}
    assert got == jaccard_pairs(rows, 3, 20, 0.6) and got


def edited(rng, base, n):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = rng.choice("uno dos tres cuatro".split())
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("bucket", [4096, 8])
def test_hot_groups_go_through_vantage_shards(spark, bucket):
    rng = random.Random(11)
    base = [f"w{rng.randrange(500)}" for _ in range(80)]
    texts = edited(rng, base, 60) + [" ".join(f"v{rng.randrange(900)}" for _ in range(60)) for _ in range(60)] + [" ".join(base)] * 5
    rows = {("t", f"{i:03d}"): x for i, x in enumerate(texts)} | {("t", "null"): None, ("t", "empty"): "", ("t", "short"): "uno dos"}
    df = spark.createDataFrame([(k[0], k[1], x, 0) for k, x in rows.items()] + [("t", "000", texts[0], 0)], "kind string, key string, body string, sid int")
    links, members = neardup.near_duplicates(df, "key", "body", "kind", similarity=0.7, n=3, least=10, bucket=bucket, vantages=4)
    assert {tuple(r) for r in neardup.record_pairs(links, members).collect()} == jaccard_pairs(rows, 3, 10, 0.7)


def test_copies_stand_as_a_star(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [("t", f"{i:04d}", text if i < 300 else text + " fin distinto") for i in range(302)]
    df = spark.createDataFrame(rows, "kind string, key string, text string")
    links, members = neardup.near_duplicates(df, "key", "text", "kind", 0.6, 3, 20)
    pairs = {(r.id_a, r.id_b) for r in neardup.record_pairs(links, members).collect()}
    assert len(pairs) == 299 + 1 + 2 and ("0000", "0299") in pairs and ("0000", "0301") in pairs
    empty = neardup.near_duplicates(df.limit(0), "key", "text", "kind")
    assert neardup.record_pairs(*empty).count() == 0


def test_groups_are_connected_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + rng.randrange(20), 100 + rng.randrange(20)) for _ in range(15)]
    edges = [(min(e), max(e)) for e in edges if e[0] != e[1]]
    links = spark.createDataFrame(edges, "a long, b long")
    members = spark.createDataFrame([("t", f"k{i:03d}", i) for i in range(130)] + [("t", "k000b", 0)], "kind string, key string, sid long")
    parent = {i: i for i in range(130)}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.key: (r.group_id, r.n_links) for r in neardup.groups(links, members).collect()}
    assert len(got) == 131 and all(got[f"k{i:03d}"][0] == f"k{root(i):03d}" for i in range(130))
    assert got["k000b"] == ("k000", 1) and got["k129"] == ("k129", 0)
    assert neardup.groups(links.limit(0), members).filter("n_links > 0").count() == 0


def test_tree_join_equals_all_pairs():
    rng = np.random.default_rng(6)
    centers = rng.integers(0, 2**63, (6, 3), dtype=np.uint64)
    fps = np.repeat(centers, 60, axis=0)
    for row in fps:
        for bit in rng.integers(0, 192, 30):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    d = np.bitwise_count(fps[:, None, :] ^ fps[None, :, :]).sum(axis=-1)
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(d <= 50, 1)))}
    got = {(min(a, b), max(a, b)) for i, j in neardup.tree_pairs(fps, np.arange(len(fps)), 50, leaf=16) for a, b in zip(i.tolist(), j.tolist())}
    assert got == want
    same = np.zeros((200, 3), np.uint64)
    assert sum(len(i) for i, _ in neardup.tree_pairs(same, np.arange(200), 0, leaf=16)) == 199 * 100


def check_pieces(text, pieces, limit, overlap):
    at = 0
    for p in pieces:
        assert text[p.start : p.end] == p.piece_text and len(p.piece_text) <= limit
        assert p.start == (max(0, at - overlap) if at else 0) and p.end > at
        at = p.end
    assert at == len(text)


@pytest.mark.parametrize("range_chars", [700, 1 << 16])
def test_split_round_trip(spark, range_chars):
    rng = random.Random(8)
    words = ["palabra", "😀", "ñandú", "frase.", "fin.\n", "\n\n", "ARTÍCULO 4°.- ", "x" * 30]
    texts = {f"t{i}": " ".join(rng.choice(words) for _ in range(rng.randrange(1, 900))) for i in range(12)}
    texts |= {"solid": "y" * 2500, "exact": "z" * 400, "over": "z" * 401, "empty": ""}
    df = spark.createDataFrame([(k, v, 1) for k, v in texts.items()] + [("null", None, 1), ("solid", texts["solid"], 2)], "id string, body string, piece int")
    got = {}
    for r in split.split_records(df, "id", "body", 400, overlap=50, range_chars=range_chars).collect():
        got.setdefault(r.key, []).append(r)
    assert set(got) == {k for k, v in texts.items() if len(v) > 400}
    for k, rows in got.items():
        check_pieces(texts[k], sorted(rows, key=lambda r: r.piece), 400, 50)
    assert split.split_records(df.limit(0), "id", "body", 400).count() == 0


def test_ranges_do_not_change_the_pieces(spark):
    text = "".join(f"ARTÍCULO {i}.- Una frase corta. Otra frase, más larga que la primera; y un final.\n\n" for i in range(400))
    df = spark.createDataFrame([("a", text)], "id string, body string")
    one, many = (split.split_records(df, "id", "body", 900, range_chars=n).select("piece", "start", "end").orderBy("piece").collect() for n in (1 << 20, 640))
    assert one == many and all(text[r.start if not r.piece else r.start + 150 :].startswith("ARTÍCULO") for r in one)


def test_files_by_byte_ranges(spark, tmp_path):
    text = "".join(f"Línea {i} con ñandúes y 😀 símbolos. Otra frase.\n" for i in range(3000))
    (tmp_path / "big.txt").write_text(text)
    (tmp_path / "none.txt").write_text("")
    data = text.encode()
    files = [(str(tmp_path / "big.txt"), len(data)), (str(tmp_path / "none.txt"), 0)]
    rows = split.split_files(spark, files, 2000, 100, range_bytes=5000).orderBy("piece").collect()
    at = 0
    for r in rows:
        assert r.end - r.start <= 2000 and r.start == (max(0, at - 100) if at else 0)
        at = r.end
        data[r.start + (100 if r.piece else 0) : r.end].decode()  # cuts stand between characters
    assert at == len(data)


def brute(vectors, k, least):
    keys = sorted(vectors)
    x = np.array([vectors[i] for i in keys])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 9)
    out = set()
    for i in range(len(keys)):
        order = sorted((j for j in range(len(keys)) if j != i), key=lambda j: (-s[i, j], keys[j]))[:k]
        out |= {tuple(sorted((keys[i], keys[j]))) for j in order if s[i, j] >= least}
    return out


def test_similar_vectors_against_brute_force(spark):
    rng = np.random.default_rng(12)
    base = rng.standard_normal((40, 64))
    near = np.repeat(base, 6, axis=0) + 0.18 * rng.standard_normal((240, 64))
    far = rng.standard_normal((400, 64))
    vectors = {f"v{i:04d}": v.astype(np.float32).tolist() for i, v in enumerate(np.vstack([near, far]))}
    rows = [("t", k, v) for k, v in vectors.items()]
    rows += [("t", "null", None), ("t", "zero", [0.0] * 64), ("t", "short", [1.0, 2.0]), ("t", "nan", [float("nan")] * 64), rows[0]]
    df = spark.createDataFrame(rows, "kind string, id string, emb array<float>").withColumn("vid", F.lit(1))
    got = {(r.id_a, r.id_b) for r in knn.similar(df, "id", "emb", "kind").collect()}
    want = brute(vectors, 5, 0.9)
    assert len(want) > 300 and got <= want and len(got & want) >= 0.99 * len(want)
    assert knn.similar(df.limit(0), "id", "emb", "kind").count() == 0


def test_copies_of_a_vector(spark):
    v = np.random.default_rng(1).standard_normal(64).astype(np.float32).tolist()
    rows = [("t", f"c{i:03d}", v) for i in range(200)] + [("u", "c000", v)]
    df = spark.createDataFrame(rows, "kind string, id string, emb array<float>")
    got = {(r.id_a, r.id_b) for r in knn.similar(df, "id", "emb", "kind").collect()}
    assert got == brute({f"c{i:03d}": v for i in range(200)}, 5, 0.9)


@pytest.mark.parametrize("block", [4096, 3])
def test_scan_equals_brute_force(spark, block, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.integers(-1, 2, (300, 6)).astype(np.float32)  # many ties
    x[x.any(axis=1) == 0] = 1
    rows = [("t", f"v{i:03d}", v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows + rows[:40] + [("u", "v000", x[0].tolist()), ("t", "v998", None)], "kind string, id string, v array<float>").repartition(3)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    cos = np.round(unit @ unit.T, 6)
    want = {(f"v{i:03d}", f"v{j:03d}") for i in range(0, 300, 29) for j in sorted((j for j in range(300) if j != i), key=lambda j: (-cos[i, j], j))[:5]}
    asked = df.filter(F.substring("id", 2, 3).cast("int") % 29 == 0)
    got = knn.scan_top_k(df, asked, "id", "v", "kind", block=block).filter("kind = 't'").collect()
    assert {(r.query, r.key) for r in got} == want and len(got) == len(want)
    assert knn.scan_top_k(df, asked.limit(0), "id", "v", "kind").count() == 0


def test_recall_on_the_test_tables(spark):
    sf = "/root/testdata/sf0.01"
    got = {tuple(r) for r in queries.p6_found(spark, sf).collect()}
    want = set()
    for name, col in (("document_paragraphs", "embedding"), ("rag_documents", "embedding_base")):
        vs = {r[0]: r[1] for r in table(spark, sf, name).select("id", col).collect() if r[1] is not None and any(r[1])}
        want |= {(name, *p) for p in brute(vs, 5, 0.9)}
    assert len(got & want) >= 0.9 * len(want) and not got - want
