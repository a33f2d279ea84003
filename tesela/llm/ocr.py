"""Noise in text from scanned pages: broken words, misread characters, running headers and page numbers.

1. Counts of all words and word pairs of the corpus, combined in the tasks before the shuffle.
2. Suspicious places of every record: rare words, words broken across lines, lines that stand in a sentence.
3. Rare words are grouped with the frequent ones of the same confusable-glyph skeleton; among these the form counts that
   the neighbouring words support. Lines with masked digits that recur in several records are headers.
4. The repair drops header lines, joins broken words and reflows lines by windows over the lines of a record.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut
from .quality import COMMON

#: The most frequent words are sent to all tasks, to pass over the usual words; at most so many (about 4 MB). Words beyond are
#: looked up by join like every other, so the bound changes no result.
FREQUENT = 100_000
#: A word is usual from this count on.
USUAL = 20
#: A word is taken for a misreading where the right form is at least so many times as frequent, however often both occur.
RATIO = 20

# Glyphs that recognition confuses, each given by what it is made of or mistaken for.
GLYPHS = {
    "l": "i", "1": "i", "|": "i", "!": "i", "í": "i", "ì": "i", "0": "o", "ó": "o", "ò": "o", "e": "c", "é": "c", "è": "c", "ê": "c", "(": "c",
    "f": "t", "+": "t", "6": "b", "5": "s", "$": "s", "4": "a", "@": "a", "á": "a", "à": "a", "â": "a", "ã": "a", "9": "g", "q": "g", "ú": "ii", "ü": "ii",
    "u": "ii", "h": "ii", "m": "rn", "d": "ci", "w": "vv", "õ": "o", "ô": "o", "ç": "c", "ñ": "n", "`": "", "´": "",
}
_SKELETON = str.maketrans(GLYPHS)
_COMMON = {w for v in COMMON.values() for w in v}
_PLAIN = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_TOKEN = re.compile(r"[(!|+]?[^\W_]+(?:[!|+(`´]+[^\W_]*)*")
_BROKEN = re.compile(r"([^\W\d_][\w!|+(`´]*)(-|¬|‐|­)[ \t\r]*\n[ \t]*([^\W\d_][\w!|+`´]*)")
_PAIR = re.compile(r"\(([^()]{0,80})\)")
_DIGIT = re.compile(r"\d")
_ROMAN = re.compile(r"[ivxlcdm]+\Z")
_PAGE = re.compile(r"[-—–]{0,2}\s*(?:p\s?[áa]\s?g(?:\s?i\s?n\s?a)?\.?|fol(?:io)?\.?|page|n[°º])?\s*#(?:\s*(?:/|de|of|-)\s*#)?\s*(?:vta\.?|r\.?|v\.?)?\s*[-—–]{0,2}\Z")
_HEADING = re.compile(r"(?:t[íi]tulo|cap[íi]tulo|secci[óo]n|section|libro|anexo|art[íi]culo|art\.|[-•*(\[|]|#[.)]|\w{1,4}[.)]\s)")
_TERMINAL = re.compile(r"[.:;!?…][\"”»’')\]]*\Z")
_BLOCK = re.compile(r"\n[ \t\r]*\n")


def skeleton(word: str) -> str:
    """The word written in glyphs that recognition confuses: 'clará' and 'dará' give the same."""
    return word.lower().translate(_SKELETON)


def masked(line: str) -> str:
    """The line with its digits masked and its spaces squeezed."""
    return re.sub(r"\s+", " ", re.sub(r"\d+(?:[.,]\d+)*", "#", line.strip().lower()))


def pair_code(a: str, b: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{a} {b}") - (1 << 63)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words and of pairs (by code, without a word), combined as far as the memory goes."""
    words: Counter = Counter()
    pairs: Counter = Counter()

    def flush() -> Iterator[pa.RecordBatch]:
        for names, codes, n in ((list(words), [0] * len(words), words), ([None] * len(pairs), [pair_code(a, b) for a, b in pairs], pairs)):
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(codes, pa.int64()), pa.array(list(n.values()), pa.int64())], names=["word", "code", "n"])
        words.clear()
        pairs.clear()

    for b in batches:
        for text in b.column("text").to_pylist():
            if not text:
                continue
            found = _PLAIN.findall(text.lower())
            words.update(found)
            pairs.update(zip(found, found[1:]))
        if len(pairs) > 400_000 or len(words) > 400_000:
            yield from flush()
    yield from flush()


def corpus_counts(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, n) and (code, n) over all texts of the column ``text``."""
    both = df.select("text").mapInArrow(_count, "word string, code long, n long")
    total = cut(both.groupBy("word", "code").agg(F.sum("n").alias("n")))
    return total.filter("word IS NOT NULL").select("word", "n"), total.filter("word IS NULL").select("code", "n")


def _is_prose(block: str, usual: frozenset) -> bool:
    words = _PLAIN.findall(block.lower())
    if len(words) < 4:
        return False
    known = sum(w in usual for w in words)
    common = sum(w in _COMMON for w in words if len(w) > 1 or w in "yaeo")
    return known >= 0.5 * len(words) and common >= 0.045 * len(words)


def suspicions(text: str | None, usual: frozenset, passed: frozenset | None = None) -> list[tuple[str, str, str, str, str]]:
    """(what, wrong, right or other form, word before, word after) of the suspicious places of one text.

    ``usual`` words make a block prose; the ``passed`` ones (by default the same) are above suspicion.
    what: 'word' (any other word in prose), 'broken' (a word broken across lines), 'page' (a line in the shape of a page number),
    'header' (a line of capitals in a sentence), 'running' (a line with capitals and digits beside prose).
    """
    out = []
    if not text:
        return out
    passed = usual if passed is None else passed
    blocks = _BLOCK.split(text)
    prose = [_is_prose(b, usual) for b in blocks]
    for k, block in enumerate(blocks):
        lines = [x for x in block.split("\n") if x.strip()]
        near = prose[k] or (len(lines) == 1 and any(prose[max(0, k - 1) : k + 2]))
        if not near:
            continue
        kept = []
        for i, line in enumerate(lines):
            x = line.strip()
            if not (x.isupper() or _DIGIT.search(x)):
                kept.append(line)
                continue
            before = lines[i - 1].strip() if i else (blocks[k - 1].strip() if k else "")
            after = lines[i + 1].strip() if i + 1 < len(lines) else (blocks[k + 1].strip() if k + 1 < len(blocks) else "")
            opens = bool(before) and not _TERMINAL.search(before)
            goes = bool(after) and after[0].islower()
            mask = masked(x) if len(x) <= 90 else ""
            letters = [c for c in x if c.isalpha()]
            if mask and "#" in mask and _PAGE.match(mask):
                bare = mask == "#"
                if (opens and (goes or not after)) if bare else (len(lines) > 1 or len(blocks) > 1):
                    out.append(("page", mask, x, "", ""))
                    continue
            elif mask and len(letters) > 5 and not _HEADING.match(mask):
                capitals = sum(c.isupper() for c in letters) / len(letters)
                if goes and ((capitals > 0.6 and (opens or not before)) or (capitals > 0.35 and "#" in mask and opens)):
                    out.append(("header", mask, x, "", ""))
                    continue
                within = 0 < i < len(lines) - 1
                if capitals > 0.35 and "#" in mask[1:] and mask[0] != "#" and not _TERMINAL.search(x) and (opens or goes or within or not before or not after) and len(lines) > 1:
                    out.append(("running", mask, x, "", ""))
                    if kept and kept[-1].rstrip()[-1:] in "-¬‐":
                        continue  # else its words are looked at like others
            kept.append(line)
        if not prose[k]:
            continue
        body = "\n".join(kept)
        for m in _BROKEN.finditer(body):
            left, mark, right = m.groups()
            if right[0].islower():
                out.append(("broken", (left + right).lower(), f"{left}-{right}".lower() if mark == "-" else "", "", ""))
        body = _BROKEN.sub(lambda m: m.group(1) + m.group(3), body)
        body = _PAIR.sub(r" \1 ", body.lower())  # an opening bracket that stays stands for a letter
        tokens = _TOKEN.findall(body)
        for i, t in enumerate(tokens):
            if t in passed or len(t) < 2:
                continue
            t = t.rstrip("!(+")
            if len(t) < 2 or t in passed or t.isdigit() or _ROMAN.match(t) or not any(c.isalpha() for c in t):
                continue
            before, after = tokens[i - 1].rstrip("!(+") if i else "", tokens[i + 1].rstrip("!(+") if i + 1 < len(tokens) else ""
            # a 6 stands for b, ó or é
            for form in {skeleton(t), skeleton(t.replace("6", "o")), skeleton(t.replace("6", "e"))}:
                out.append(("word", t, form, before, after))
    return out


def _suspect(usual: frozenset, passed: frozenset):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(kind, key, *s) for kind, key, text in zip(pdf["kind"], pdf["key"], pdf["text"]) for s in suspicions(text, usual, passed)]
            yield pd.DataFrame(rows, columns=["kind", "key", "what", "wrong", "other", "before", "after"])

    return run


def _only_accents(wrong: str, right: str) -> Column:
    """Whether a word of letters differs from another in its accents alone, which is no mark of scanning."""
    accents = ("áéíóúàèìòùâêôãõüñç", "aeiouaeiouaeoaounc")
    return ~F.col(wrong).rlike(r"[^\p{L}]") & (F.translate(wrong, *accents) == F.translate(right, *accents))


def usual_words(words: DataFrame) -> tuple[frozenset, frozenset]:
    """The usual words, and those of them that are passed over: without the ones that have a form of the same skeleton at least
    ``RATIO`` times as frequent, since a misreading that recurs grows with the corpus."""
    common = words.filter(F.col("n") >= USUAL).withColumn("other", _skeleton_sql(F.col("word")))
    right = common.select("other", F.col("word").alias("right"), F.col("n").alias("n_right"))
    doubtful = common.join(right, "other").filter((F.col("n_right") >= RATIO * F.col("n")) & ~_only_accents("word", "right")).select("word", F.lit(True).alias("doubtful")).distinct()
    top = common.join(doubtful, "word", "left").orderBy(F.desc("n"), "word").limit(FREQUENT).select("word", "doubtful").toArrow()
    names = top.column("word").to_pylist()
    return frozenset(names), frozenset(w for w, x in zip(names, top.column("doubtful").to_pylist()) if not x)


def scan_damage(df: DataFrame, key: str, text: str, kind: str) -> DataFrame:
    """(kind, key, what, wrong, right) of every damage found; rows of one key count once.

    A word is misread where a form of the same skeleton is at least 20 times as frequent and, for words of up to 4 letters
    or with a rival form, stands beside one of its neighbours elsewhere too. A word that is broken at a plain hyphen counts
    unless the hyphenated form is a word of its own. A masked page number counts from two records on, a running
    line from three; they must stand in prose. Null and empty texts, lists, tables and debris give nothing.
    """
    rows = df.select(F.col(kind).alias("kind"), F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    words, pairs = corpus_counts(rows)
    found = cut(rows.mapInPandas(_suspect(*usual_words(words)), "kind string, key string, what string, wrong string, other string, before string, after string").distinct())

    # misread words
    rare = found.filter("what = 'word'").select("kind", "key", "wrong", "other", "before", "after")
    forms = words.filter(F.col("n") >= USUAL // 2).select(F.col("word").alias("right"), F.col("n").alias("n_right"), _skeleton_sql(F.col("word")).alias("other"))
    own = words.select(F.col("word").alias("wrong"), F.col("n").alias("n_wrong"))
    kinds = rare.select("wrong", "other").distinct().join(forms, "other").filter("wrong != right").join(own, "wrong", "left")
    kinds = kinds.filter(F.col("n_right") >= RATIO * F.coalesce("n_wrong", F.lit(0))).select("wrong", "right", "n_right")
    asked = rare.join(kinds, "wrong")
    near = asked.withColumn("c", F.explode(F.array(F.struct(F.col("before").alias("a"), F.col("right").alias("b")), F.struct(F.col("right").alias("a"), F.col("after").alias("b"))))).select("wrong", "right", "c.a", "c.b").distinct()
    coded = near.mapInPandas(_codes, "wrong string, right string, a string, b string, code long").join(pairs, "code").select("wrong", "right", "a", "b", "n")
    left = coded.select("wrong", "right", F.col("a").alias("before"), F.col("n").alias("n_before"), F.col("b").alias("__b")).filter("right = __b").drop("__b")
    rightward = coded.select("wrong", "right", F.col("b").alias("after"), F.col("n").alias("n_after"), F.col("a").alias("__a")).filter("right = __a").drop("__a")
    scored = asked.join(left, ["wrong", "right", "before"], "left").join(rightward, ["wrong", "right", "after"], "left")
    support = F.coalesce("n_before", F.lit(0)) + F.coalesce("n_after", F.lit(0))
    best = Window.partitionBy("kind", "key", "wrong", "before", "after").orderBy(F.desc("support"), F.desc("n_right"), "right")
    chosen = scored.withColumn("support", support).withColumn("rank", F.row_number().over(best)).filter("rank = 1")
    misread = chosen.filter(((F.col("support") > 0) | (F.length("wrong") > 4)) & ~_only_accents("wrong", "right")).select("kind", "key", F.lit("word").alias("what"), "wrong", "right")

    # words broken across lines
    broken = found.filter("what = 'broken'").select("kind", "key", "wrong", "other")
    compound = words.select(F.col("word").alias("other"), F.col("n").alias("n_compound"))
    joined = words.select(F.col("word").alias("wrong"), F.col("n").alias("n_joined"))
    split = broken.join(compound, "other", "left").join(joined, "wrong", "left")
    split = split.filter((F.coalesce("n_compound", F.lit(0)) < 2) | (F.coalesce("n_joined", F.lit(0)) > F.col("n_compound"))).select("kind", "key", F.lit("broken").alias("what"), F.col("other").alias("wrong"), F.col("wrong").alias("right"))

    # running headers and page numbers
    lines = found.filter("what IN ('page', 'header', 'running')")
    often = lines.groupBy("wrong").agg(F.count_distinct("kind", "key").alias("records"))
    standing = lines.join(often, "wrong").filter((F.col("what") == "header") | (F.col("records") >= F.when(F.col("what") == "page", 2).otherwise(3))).select("kind", "key", "what", F.col("other").alias("wrong"), F.lit("").alias("right"))
    return misread.unionByName(split).unionByName(standing).distinct()


def _codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(code=pd.Series([pair_code(a, b) for a, b in zip(pdf["a"], pdf["b"])], dtype="int64", index=pdf.index))


def _skeleton_sql(word: Column) -> Column:
    """``skeleton`` as an expression: single glyphs by translate, the rest by replace."""
    single = {k: v for k, v in GLYPHS.items() if len(v) == 1}
    gone = [k for k, v in GLYPHS.items() if not v]
    c = F.translate(word, "".join(single) + "".join(gone), "".join(single.values()))
    for k, v in GLYPHS.items():
        if len(v) > 1:
            c = F.replace(c, F.lit(k), F.lit(v))
    return c


def repaired(df: DataFrame, key: str, text: str, kind: str, damage: DataFrame | None = None) -> DataFrame:
    """(kind, key, text): the damaged records as continuous paragraphs.

    Header lines go, broken words are joined, misread words replaced; a line goes on from the one before unless a blank line,
    a heading or an entry begins. Records without damage come out unchanged, null texts as null; one row per key.
    """
    rows = df.select(F.col(kind).alias("kind"), F.col(key).cast("string").alias("key"), F.col(text).alias("text")).dropDuplicates(["kind", "key"])
    damage = cut(damage if damage is not None else scan_damage(df, key, text, kind))
    gone = damage.filter("what IN ('page', 'header', 'running')").groupBy("kind", "key").agg(F.collect_set("wrong").alias("gone"))
    fixes = damage.filter("what = 'word'").groupBy("kind", "key").agg(F.collect_set(F.struct("wrong", "right")).alias("fixes"))
    joins = damage.filter("what = 'broken'").groupBy("kind", "key").agg(F.collect_set("right").alias("joins"))
    hit = rows.join(damage.select("kind", "key").distinct(), ["kind", "key"], "left_semi")
    with_all = hit.join(gone, ["kind", "key"], "left").join(fixes, ["kind", "key"], "left").join(joins, ["kind", "key"], "left")
    lines = with_all.select("kind", "key", "gone", "fixes", "joins", F.posexplode(F.split("text", r"\r?\n")).alias("no", "line"))
    lines = lines.withColumn("line", F.trim("line")).filter(F.col("gone").isNull() | ~F.array_contains("gone", F.col("line")))
    w = Window.partitionBy("kind", "key").orderBy("no")
    before = F.lag("line").over(w)
    tail = F.regexp_extract(before, r"([\p{L}][\p{L}\p{N}!|+(`´]*)[-¬‐\x{AD}]$", 1)
    head = F.regexp_extract("line", r"^([\p{L}\p{N}!|+`´]+)", 1)
    lines = lines.withColumn("glue", (tail != "") & F.array_contains("joins", F.lower(F.concat(tail, head))))
    entry = F.col("line").rlike(r"^(?:[-•*]|\(?[\p{L}\p{N}]{1,4}[.)]|\[[ xX]?\]|\|)\s|^(?i:art[íi]culo|art\.|section|t[íi]tulo|cap[íi]tulo|libro|anexo)\s")
    start = before.isNull() | (F.trim(before) == "") | (F.trim("line") == "") | (entry & ~F.col("glue"))
    lines = lines.withColumn("lead_in", F.when(F.col("glue"), "").when(start, F.when(before.isNull(), "").otherwise("\n")).otherwise(" "))
    lines = lines.withColumn("glued", F.coalesce(F.lead("glue").over(w), F.lit(False)))
    body = F.when(F.col("glued"), F.regexp_replace("line", r"[-¬‐\x{AD}]$", "")).otherwise(F.col("line"))
    text_of = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", F.concat("lead_in", body).alias("t")))), lambda x: x["t"]), "")
    flat = lines.groupBy("kind", "key").agg(text_of.alias("text"), F.first("fixes", ignorenulls=True).alias("fixes"))
    edge_l, edge_r = r"(?i)(?<![\p{L}\p{N}])\Q", r"\E(?![\p{L}\p{N}])"
    mended = F.aggregate(
        F.coalesce("fixes", F.array().cast("array<struct<wrong:string,right:string>>")),
        F.col("text"),
        lambda t, f: F.regexp_replace(t, F.concat(F.lit(edge_l), f["wrong"], F.lit(edge_r)), f["right"]),
    )
    done = flat.select("kind", "key", mended.alias("text"))
    return done.unionByName(rows.join(damage.select("kind", "key").distinct(), ["kind", "key"], "left_anti"))
