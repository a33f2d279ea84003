"""Quality, scans, cut texts, packing, leaks and content scores against plain versions, and their edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark import SparkFiles
from pyspark.sql import functions as F

from tesela.llm import leak, ocr, pack, quality, queries, toxic, truncate
from tesela.session import table

PROSE = "El titular deberá presentar la solicitud ante la oficina, y no se admitirá otro trámite sin la constancia que corresponde."
LIST = "- puerto hídrico\n- norma fiscal (prueba)\n- plazo del juzgado\n- mina\n- tasa rural"


def test_quality_marks_lists_tables_and_debris(spark):
    texts = {f"p{i}": PROSE.replace("titular", w) for i, w in enumerate("titular dueño agente vecino juez síndico".split() * 5)}
    texts |= {"list": LIST, "table": "\n".join(f"tasa {i} ..... 12/0{i}/2020 77{i},5 - 3%" for i in range(1, 8)), "junk": "lvvbx xlxrrv ds vflbsqc jhdlclz mrclvjpc mrnllv mpkwkkzr", "blank": "", "marks": "=== ### ----", "scan": PROSE.replace(" la ", "\nla ")}
    df = spark.createDataFrame([(k, v, "x", 1) for k, v in texts.items()] + [("none", None, "x", 1), ("p0", texts["p0"], "x", 1)], "id string, body string, language string, n_words int")
    got = {}
    for r in quality.quality(df, "id", "body").collect():
        got.setdefault(r.id, []).append(r.is_prose)
    assert got["none"] == [None] and len(got["p0"]) == 2
    assert {k for k, v in got.items() if v[0] is False} == {"list", "table", "junk", "blank", "marks"}


def test_quality_statistics_by_hand(spark):
    df = spark.createDataFrame([("a", "Uno dos. Tres\nCUATRO 5!")], "id string, body string")
    r = quality.document_stats(df, "body").first()
    assert (r.n_words, r.n_lines) == (5, 2) and r.line_end_share == 0.5 and r.digit_word_ratio == pytest.approx(0.2)
    assert quality.quality(df.limit(0), "id", "body").count() == 0


def test_sketches_merge_and_hold_quantiles(spark):
    df = spark.range(5000).select(F.lit("es").alias("language"), *[(F.col("id") / 5000.0).alias(s) for s in quality.STATS])
    med = quality.profile(quality.sketches(df.repartition(7))).first().common_share_med
    assert abs(med - 0.5) < 0.03


def scans(spark):
    rng = random.Random(3)
    nouns = "deber plazo registro tributo juzgado oficina mercado titular".split()
    clean = [f"El {rng.choice(nouns)} de la oficina no podrá fijar el {rng.choice(nouns)} sin la norma que corresponde al {rng.choice(nouns)} socio-económico, y se dará traslado." for _ in range(300)]
    rows = [("t", f"c{i}", x) for i, x in enumerate(clean)]
    rows += [
        ("t", "hyphen", "El registro de la ofi-\ncina no podrá fijar el plazo sin la norma que corresponde."),
        ("t", "soft", "El registro de la ofi¬\ncina no podrá fijar el plazo sin la norma que corresponde."),
        ("t", "glyph", "El regis+ro de la oficina no p0drá fijar el plazo sin la norma que corresponde."),
        ("t", "letters", "El registro de la oficina no podrá fijar el tributo y se clará traslado de la norma."),
        ("t", "page", "El registro de la oficina no podrá\n-- 2 of 6 --\nfijar el plazo sin la norma que corresponde."),
        ("t", "page2", "El registro de la oficina no podrá\n-- 3 of 6 --\nfijar el plazo sin la norma que corresponde."),
        ("t", "header", "El registro de la oficina no podrá\nBOLETÍN DE LEY N° 9.800 DE AGUAS\nfijar el plazo sin la norma que corresponde."),
        ("t", "compound", "El registro de la oficina no podrá fijar el plazo socio-\neconómico sin la norma que corresponde."),
        ("t", "breaks", "El registro de la oficina\nno podrá fijar el plazo\nsin la norma que corresponde."),
        ("t", "list", LIST),
        ("t", "none", None),
        ("t", "empty", ""),
    ]
    return spark.createDataFrame(rows + rows[-14:], "kind string, key string, text string")


def test_scan_damage_and_repair(spark):
    df = scans(spark)
    found = ocr.scan_damage(df, "key", "text", "kind")
    by = {}
    for r in found.collect():
        by.setdefault(r.key, set()).add((r.what, r.right))
    assert set(by) == {"hyphen", "soft", "glyph", "letters", "page", "page2", "header"}
    assert by["glyph"] == {("word", "registro"), ("word", "podrá")} and by["letters"] == {("word", "dará")}
    text = {r.key: r.text for r in ocr.repaired(df, "key", "text", "kind").collect()}
    want = "El registro de la oficina no podrá fijar el plazo sin la norma que corresponde."
    assert text["hyphen"] == text["soft"] == text["page"] == text["header"] == text["glyph"] == want
    assert text["none"] is None and text["empty"] == "" and text["list"] == LIST
    assert ocr.scan_damage(df.limit(0), "key", "text", "kind").count() == 0


def test_misreadings_that_recur_are_found_too(spark):
    text = "El registro {} no podrá fijar el plazo sin la norma que corresponde y se dará {} al titular."
    rows = [("t", f"c{i}", text.format("de la oficina", "traslado")) for i in range(600)]
    rows += [("t", f"w{i}", text.format("de la oficina", "traslaclo")) for i in range(25)]
    rows += [("t", f"s{i}", text.format("cle la oficina", "traslado")) for i in range(25)]
    rows += [("t", f"u{i}", text.format("de la oficina", "fallo")) for i in range(100)] + [("t", f"v{i}", text.format("de la oficina", "tallo")) for i in range(25)]
    found = {(r.key, r.wrong, r.right) for r in ocr.scan_damage(spark.createDataFrame(rows, "kind string, key string, text string"), "key", "text", "kind").collect()}
    assert found == {(f"w{i}", "traslaclo", "traslado") for i in range(25)} | {(f"s{i}", "cle", "de") for i in range(25)}


def test_skeleton_as_expression(spark):
    words = ["clará", "dará", "rnódulo", "módulo", "C0SA", "habrá", "liabrá", "vvalter", "último", "sera`"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for r in df.select("w", ocr._skeleton_sql(F.lower("w")).alias("s")).collect():
        assert r.s == ocr.skeleton(r.w)
    assert ocr.skeleton("clará") == ocr.skeleton("dará") and ocr.skeleton("rnódulo") == ocr.skeleton("módulo")


def test_cut_answers(spark):
    full = "La tasa comprende el registro, la oficina y el plazo. El titular no podrá fijar la norma en un plazo de 5 días."
    rows = [("a", f"w{i}", full.replace("tasa", w)) for i, w in enumerate("tasa multa cuota deuda beca".split() * 4)]
    rows += [("a", "word", full + " El titular no podrá fijar la nor"), ("a", "mid", full + " El titular no podrá fijar la norma en un"), ("a", "dots", full + " La multa comprende el registro..."), ("a", "mark", full + " El titular no podrá fijar la norma �")]
    rows += [("a", "nostop", full[:-1]), ("a", "cite", full[:-1].replace("tasa", "veda") + " (Fuente 3)"), ("a", "list", "Incluye:\n- tasa\n- multa"), ("a", "others", full[:-1].replace("tasa", "caja") + ", entre otros..."), ("a", "null", None), ("a", "blank", "  ")]
    df = spark.createDataFrame(rows + rows[:2], "kind string, id string, answer string").withColumn("key", F.lit(1)).withColumn("reason", F.lit("x"))
    got = {r.key: r.reason for r in truncate.truncated_answers(df, "id", "answer").collect()}
    assert set(got) == {"word", "mid", "dots", "mark"} and got["word"] == "word" and got["mid"] == "sentence"
    assert truncate.truncated_answers(df.limit(0), "id", "answer").count() == 0


def test_copies_of_a_cut_answer_are_no_witnesses(spark):
    full = "La tasa comprende el registro, la oficina y el plazo. El titular no podrá fijar la norma en un plazo de 5 días."
    cut = full + " El titular no podrá fijar la norma en un"
    whole = [("a", f"w{i}", full.replace("tasa", w).replace("5", str(i))) for i, w in enumerate("tasa multa cuota deuda beca".split() * 4)]
    ends = [("a", f"e{i}", f"No hay fuentes para la {w}") for i, w in enumerate("tasa multa cuota deuda beca".split())]
    for n in (1, 3, 40):
        df = spark.createDataFrame(whole + ends + [("a", f"cut{i}", cut + " " * (i % 3)) for i in range(n)], "kind string, id string, answer string")
        got = {r.key: r.reason for r in truncate.truncated_answers(df, "id", "answer").collect()}
        assert got == {f"cut{i}": "sentence" for i in range(n)}


def test_cut_copies(spark):
    body = "Este es el contenido completo del párrafo que se copia en otro campo de la misma fila, con un final."
    rows = [("p", "whole", "Documento: x\n\nantes. " + body.replace(" se ", "\nse "), body), ("p", "cut", "Documento: x\n\nantes. " + body[:70] + "...", body), ("p", "early", "Documen", body), ("p", "null", None, body), ("p", "cut", "Documento: x\n\nantes. " + body[:70] + "...", body)]
    df = spark.createDataFrame(rows, "kind string, id string, text string, source string")
    got = {r.key: r.reason for r in truncate.truncated_copies(df, "id", "text", "source").collect()}
    assert got == {"cut": "prefix", "early": "lost"}
    rates = truncate.truncation_rates(truncate.truncated_copies(df, "id", "text", "source"), df.withColumn("s", F.lit(None).cast("string")), "id", "s").first()
    assert (rates.n, rates.n_truncated) == (4, 2)


def test_strict_prefixes_equal_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abc ") for _ in range(rng.randrange(40, 90))) for _ in range(40)]
    values = base + [b[: rng.randrange(30, len(b))] for b in base] + base[:5] + ["", None]
    df = spark.createDataFrame(list(enumerate(values)), "k long, v string")
    bare = [re.sub(r"\s+", "", v or "") for v in values]
    want = {i for i, a in enumerate(bare) if len(a) >= 20 and any(b != a and b.startswith(a) for b in bare)}
    assert {r.key for r in truncate.strict_prefixes(df, "k", "v", length=20).collect()} == want


def test_packing(spark):
    rng = random.Random(1)
    sizes = [rng.choice([1, 5, 300, 999, 1000, 1500, 2500]) for _ in range(400)] + [0, 1000]
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)] + [(9999, None, "x"), (7, sizes[7], "x")], "id long, size long, piece string")
    for shard in (10**9, 20_000):
        rows = pack.pack(df, "id", F.col("size"), capacity=1000, shard_tokens=shard).collect()
        fill = Counter()
        for r in rows:
            if r.bin_id != "empty":
                fill[r.bin_id] += r.n_tokens
        assert max(fill.values()) <= 1000 and sum(fill.values()) == sum(sizes) + sizes[7]
        assert {r.id for r in rows if r.bin_id == "empty"} == {400, 9999}
        pieces = Counter(r.id for r in rows)
        assert all(pieces[i] == max(1, math.ceil(s / 1000)) * (2 if i == 7 else 1) for i, s in enumerate(sizes))
        assert len(fill) <= 1.08 * sum(fill.values()) / 1000
    assert pack.pack(df.limit(0), "id", F.col("size")).count() == 0
    report = pack.bin_report(pack.pack(df, "id", F.col("size"), capacity=1000), 1000).first()
    assert report.filled > 0.92
    assert spark.range(1).select(pack.byte_tokens(F.lit("añ")).alias("n")).first().n == 4


def test_sum_of_squares_takes_the_smallest_change():
    p = pack.SumOfSquares(10)
    rng = random.Random(2)
    for _ in range(300):
        size = rng.randrange(1, 11)
        before = p.count.copy()
        best = min([2 * int(before[g - size]) - 2 * int(before[g]) + 2 if g > size else 1 - 2 * int(before[g]) for g in range(size, 11) if before[g]] + [2 * int(before[10 - size]) + 1 if size < 10 else 0])
        p.place(size)
        assert int((p.count.astype(int) ** 2).sum() - (before.astype(int) ** 2).sum()) == best


def test_leaks_equal_brute_force(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "heldout_items")
    grams = {}
    for r in items.collect():
        w = leak.words_of(r.text)
        for i in range(len(w) - 15):
            grams.setdefault(tuple(w[i : i + 16]), set()).add(r.item_id)
    want = set()
    for r in docs.collect():
        w = leak.words_of(r.text)
        for i in range(len(w) - 15):
            want |= {(r.doc_id, item) for item in grams.get(tuple(w[i : i + 16]), ())}
    got = {(r.doc_id, r.item_id) for r in leak.leaked(docs, items).collect()}
    assert got == want and want


def test_leaks_at_the_edges(spark):
    words = [f"palabra{i}" for i in range(40)]
    items = spark.createDataFrame([(1, " ".join(words[:20]), "x"), (2, None, "x"), (3, "", "x")], "item_id long, text string, fp string")
    docs = [(1, "X, " + " - ".join(w.upper() for w in words[2:18])), (2, " ".join(words[2:17])), (3, None), (4, ""), (5, " ".join(["relleno"] * 500 + words[4:20])), (5, "repetido")]
    got = {(r.doc_id, r.item_id, r.longest_span) for r in leak.leaked(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got == {(1, 1, 16), (5, 1, 16)}
    assert leak.words_of("Ａrtículo, articúlo") == ["articulo", "articulo"]
    h = np.array([5, 3, 3, 9, 1, 7, 7, 2], np.uint64)
    for w in (1, 3, 8, 20):
        assert all(any(i <= p < i + min(w, 8) for p in leak.winnow(h, w)) for i in range(8 - min(w, 8) + 1))


def test_maximal_segments_equal_the_definition():
    rng = random.Random(4)
    for _ in range(200):
        s = [rng.choice([-2.0, -1.0, 0.5, 1.0, 2.0]) for _ in range(rng.randrange(0, 14))]
        left, want = [(0, len(s))], []
        while left:
            a, b = left.pop()
            best = max(((round(sum(s[i:j]), 6), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
            if best and best[0] > 0:
                want.append((best[2], best[3]))
                left += [(a, best[2]), (best[3], b)]
        got = [(a, b) for a, b, _ in toxic.maximal_segments(s, 1e-9)]
        total = lambda segs: round(sum(sum(s[a:b]) for a, b in segs), 6)
        assert total(got) == total(want)


def test_unmasking():
    assert toxic.tokens("c411473 CALLATE callllate k4ll4te") == ["caiate"] * 4
    assert toxic.tokens("a f u e r a ya") == ["<spaced>", "afuera", "ya"]
    assert toxic.tokens("un fa.vor y z****no") == ["un", "<dotted>", "favor", "y", "<masked>"]
    assert toxic.tokens("dijo “te odio” hoy") == ["dijo", "“te", "“odio", "hoy"]
    assert toxic.tokens(None) == toxic.tokens("") == []


def test_content_scores_on_held_out_documents(spark):
    rng = random.Random(9)
    nouns = "plazo registro tributo juzgado mercado titular puerto bosque".split()
    plain = lambda: f"El {rng.choice(nouns)} deberá fijar el {rng.choice(nouns)} ante el {rng.choice(nouns)} en un plazo de {rng.randrange(99)} días."
    bad = ["sos una basura inmunda y nadie te soporta", "que se mueran esos inútiles de porquería", "te voy a romper la cara maldito cobarde"]
    rows, labels = [], []
    for i in range(600):
        toxic_ = i % 10 == 0
        text = " ".join([plain(), bad[(i // 10) % 3].upper() + "!" if toxic_ else plain(), plain()])
        if i % 50 == 1:
            text = plain() + " El testigo dijo que le gritaron “te voy a romper la cara” en el puerto. " + plain()
        rows.append((i, text, "s"))
        if i < 300:
            labels.append((i, "abusive" if toxic_ else "ok"))
    rows += [(9001, None, None), (9002, "", "s"), (9003, "palabra " * 20000, "s")]
    labels += [(5, "abusive"), (0, None), (77777, "ok")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("key", F.lit("x"))
    labs = spark.createDataFrame(labels, "doc_id long, label string")
    scores = toxic.content_scores(docs, labs)
    found = {r.doc_id for r in scores.filter("n_passages > 0").collect()}
    want = {i for i in range(0, 600, 10)}
    assert len(found & want) >= 0.95 * len(want) and len(found - want) <= 2
    rates = {r.source: (r.n, r.n_found) for r in toxic.content_rates(scores, docs).collect()}
    assert rates["s"][0] == 602 and rates[None] == (1, 0)
    none = toxic.content_scores(docs, labs.limit(0))
    assert none.filter("n_passages > 0").count() == 0 and none.count() == docs.count()
    assert toxic.content_scores(docs.limit(0), labs).count() == 0


def test_a_model_of_many_features_loses_none(spark):
    rng = random.Random(4)
    nouns = [a + b for a in "plaz registr tribut juzgad mercad titular puert bosqu".split() for b in "o a es illo eza".split()]
    plain = lambda: f"El {rng.choice(nouns)} deberá fijar el {rng.choice(nouns)} ante el {rng.choice(nouns)} en un plazo de {rng.randrange(99)} días."
    bad = ["sos una basura inmunda y nadie te soporta", "que se mueran esos inútiles de porquería", "te voy a romper la cara maldito cobarde"]
    docs = spark.createDataFrame([(i, " ".join([plain(), bad[(i // 10) % 3] if i % 10 == 0 else plain(), plain()])) for i in range(400)] + [(900, None), (901, "")], "doc_id long, text string")
    labs = spark.createDataFrame([(i, "abusive" if i % 10 == 0 else "ok") for i in range(200)], "doc_id long, label string")
    marked = toxic.tokenized(docs, labs, "doc_id", "text").cache()
    sent, joined = (toxic.fit(marked, labs, "doc_id", most=most) for most in (100_000, 20))
    names = [f"w {f}" for f in sent.words] + [f"p {f}" for f in sent.pairs]
    assert sent.table is None and {r.f: r.weight for r in joined.table.collect()} == pytest.approx(dict(zip(names, [*sent.words.values(), *sent.pairs.values()])))
    want, got = ({r.doc_id: r for r in toxic.content_scores(docs, labs, most=most).collect()} for most in (100_000, 20))
    assert len({k for k, r in got.items() if r.n_passages} & set(range(0, 400, 10))) >= 36 and got.keys() == want.keys()
    for k, r in want.items():
        assert (got[k].score, got[k].log10_e) == pytest.approx((r.score, r.log10_e)) and (got[k].n_passages, got[k].passage) == (r.n_passages, r.passage)


def test_a_large_model_takes_empty_documents_and_batches_of_one_mark(spark):
    texts = [f"El plazo {n} vence" if i % 5 else "sos una basura inmunda" for i, n in enumerate("uno dos tres cuatro cinco seis siete ocho nueve diez".split() * 4)]
    docs = spark.createDataFrame([*enumerate(texts), (900, None), (901, ""), (902, " ")], "doc_id long, text string")
    labs = spark.createDataFrame([(i, "ok" if i % 5 else "abusive") for i in range(0, 40, 2)], "doc_id long, label string")
    want, got = ({r.doc_id: r for r in toxic.content_scores(docs, labs, most=most).collect()} for most in (100_000, 3))
    assert got.keys() == want.keys() and [got[k].score for k in (900, 901, 902)] == [0.0] * 3
    for k, r in want.items():
        assert (got[k].score, got[k].log10_e) == pytest.approx((r.score, r.log10_e)) and (got[k].n_passages, got[k].passage) == (r.n_passages, r.passage)
    for f in ("w plazo", "p el plazo"):
        counts = spark.createDataFrame([(f, 1.0, 2.0)], "f string, n_in double, n_out double")
        assert [r.f for r in toxic._model(counts, 0.8, 1.3, -1.2, 0).table.collect()] == [f]


def test_a_large_model_is_looked_up_without_moving_documents(spark, monkeypatch):
    weights = {"w plazo": 1.0, "w “plazo": 2.0, "p ^ plazo": -0.5, "p plazo vence": 0.25, "w ñandú": 4.0}
    table = spark.createDataFrame(list(weights.items()), "f string, weight double")
    texts = ["plazo vence", "", "“plazo", "ñandú plazo nada", ""]
    monkeypatch.setattr(toxic, "BLOCK", 12)
    for weak in (False, True):
        if weak:  # all features agree in the first hash
            names = sorted(weights, key=lambda f: toxic._hashes([f])[1][0])
            real = toxic._hashes
            monkeypatch.setattr(toxic, "_hashes", lambda names: (np.zeros(len(names), "int64"), real(names)[1]))
            file = f"{SparkFiles.getRootDirectory()}/weak"
            np.stack([*toxic._hashes(names), np.array([weights[f] for f in names]).view("int64")]).tofile(file)
        else:
            file = toxic._spread(table)
        model, seen, got = toxic.Model({}, {}, -1.0, file=file), [], {}
        for part in toxic._looked_up(model, iter([pd.DataFrame({"key": range(5), "tokens": texts})])):
            seen.append(part["key"].tolist())
            got |= {f"w {f}": x for f, x in model.words.items()} | {f"p {f}": x for f, x in model.pairs.items()}
        assert got == weights and len(seen) > 1 and sum(seen, []) == list(range(5))
    docs = toxic.tokenized(spark.createDataFrame([(1, "plazo")], "doc_id long, text string"), None, "doc_id", "text")
    plan = toxic._over(docs, toxic.Model({}, {}, -1.0, table, file), lambda m: toxic._score(m, 1.0), "key long, score double, log10_e double, n_passages int, passage string")
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_registered_queries_have_the_stated_columns(spark, sf):
    want = {"p1_found": ["id"], "p2_found": ["rec_table", "rec_id"], "p3_found": ["rec_table", "id_a", "id_b"], "p4_found": ["rec_table", "rec_id"], "p5_found": ["rec_table", "rec_id"], "p6_found": ["rec_table", "id_a", "id_b"], "p7_found": ["doc_id"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id"]}
    for name, cols in want.items():
        df = queries.QUERIES[name](spark, sf)
        rows = df.collect()
        assert df.columns == cols and len(rows) == len(set(rows))
