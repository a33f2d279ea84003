"""Text cut off by field limits: prefix self-joins of values, of sentence patterns and of words.

Three prefix joins, each by hash or sort and none of them pairing all members of a group:

- values: in sorted order, a strict prefix stands directly before a longer copy (window over hashed prefixes);
- sentences: the pattern of a value's last sentence is looked up among the patterns of whole sentences elsewhere;
- words: the last word is looked up among the words elsewhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .quality import COMMON

PREFIX = 48
#: Pattern words by which the end of a sentence is known.
GRAM = 4
# Articles and contractions, beside the common words.
_ARTICLES = "el la los las de del al o os as do da dos das no na the of a an um uma un una".split()
_KEEP = {w for v in COMMON.values() for w in v} | set(_ARTICLES)
_TOKEN = re.compile(r"[^\W\d_]+|\d[\d.,]*|[,;]")
_MARK = re.compile(r"(?:\s|\.{2,}|…|\[\s*(?:\.\.\.|…)\s*\]|�)+\Z")
_WHOLE_END = re.compile(r"(?:entre\s+otr[oa]s|y\s+dem[áa]s|y\s+otr[oa]s|etc|and\s+others|e\s+outr[oa]s)[.…,;:]*\s*\Z", re.I)
_CITATION = re.compile(
    r"(?:[(\[]\s*(?:fuente|fonte|source)s?[^()\[\]]*[)\]]|[—–-]\s*frag\.?\s*\d+|\n\s*(?:fuente|fonte|source)s?\s*:[^\n]*\w[^\n]*|\(seg[úu]n[^()]*\))[.…]?\s*\Z", re.I
)
_TERMINAL = re.compile(r"(?<!\.)[.!?:;][\"”»’')\]]*\s*\Z")
_ENTRY = re.compile(r"\s*(?:[-•*·–]|\(?[\divxlc]{1,5}[.)]|\(?[a-z][.)]|\[[ xX]?\]|\||\d+\.\d+)\s*\S")
_SENTENCE = re.compile(r"(?<=[.!?])[\"”»’')\]]*\s+(?=[^\W\d_]|[¿¡“\"«])|\n\s*")


def pattern_of(sentence: str) -> str:
    """The sentence with noun phrases folded: common words and commas stay, other words become x, numbers #."""
    out: list[str] = []
    for t in _TOKEN.findall(sentence):
        w = t.lower()
        k = w if w in _KEEP or w in ",;" else "#" if w[0].isdigit() else "x"
        out.append(k)
    s = " ".join(out)
    s = re.sub(r"\bx(?: x)+\b", "x", s)
    s = re.sub(r"\b(?:el|la|los|las|un|una|al|del|o|os|as|ao|do|da|the|a|an) x\b", "N", s)
    s = re.sub(r"\bN(?: (?:de|of) N| N)+", "N", s)
    return re.sub(r"\bde N\b", "N", s).replace("N N", "N")


def look_at_end(text: str | None) -> tuple[str, str, str]:
    """(state, pattern of the last sentence, last word). States: whole, open (no sentence end), mark (a cut mark stands
    there), entry (ends in an entry of a list or a row), quote (a quotation stays open), empty."""
    if text is None or not text.strip():
        return "empty", "", ""
    if _WHOLE_END.search(text) or _CITATION.search(text):
        return "whole", "", ""
    body = _MARK.sub("", text)
    if not body:
        return "empty", "", ""
    words = re.findall(r"[^\W\d_]+|\d[\d.,]*", body[-200:])
    last = words[-1].lower() if words and re.search(r"[\w]\Z", body) else ""
    lines = [x for x in body.split("\n") if x.strip()]
    tail = _SENTENCE.split(body)[-1] if body else ""
    quotes = body.count("“") > body.count("”") or body.count("«") > body.count("»")
    broken = text.rstrip().endswith("�") or re.search(r"[-\w,](?:\.\.\.|…)\s*\Z", text) is not None
    if not broken and _TERMINAL.search(text):
        return "whole", "", last
    inline = len(re.findall(r"\s[/|·–-]\s|;\s", tail)) >= 2
    ends_in_entry = inline or bool(_ENTRY.match(lines[-1])) or (len(lines) >= 3 and all(len(x.split()) < 9 for x in lines[-2:]) and not any(re.search(r"[.;:]\Z", x.strip()) for x in lines[-3:-1]))
    if ends_in_entry:
        return "entry", pattern_of(lines[-1]), last
    if broken:
        return "mark", pattern_of(tail), last
    if re.search(r"[”»\")\]]\Z", body) and not quotes:
        return "whole", "", last
    shape = pattern_of(tail)
    if shape.count(",") >= 2 and re.fullmatch(r"(?:[xN#,;]|of)(?: (?:[xN#,;]|of))*", shape):
        return "entry", shape, last
    return ("quote" if quotes else "open"), shape, last


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        seen = [look_at_end(t) for t in pdf["text"]]
        yield pd.DataFrame({"kind": pdf["kind"], "key": pdf["key"], "value": pdf["value"], "state": [s[0] for s in seen], "pattern": [s[1] for s in seen], "last_word": [s[2] for s in seen]})


def _whole_patterns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found: dict[str, int] = {}
        for text in pdf["text"]:
            if not text:
                continue
            parts = _SENTENCE.split(text)
            if not _TERMINAL.search(text) or _MARK.search(text.rstrip()):
                parts = parts[:-1]
            for p in parts:
                # entries of lists end in full stops too; a sentence holds a common word
                if p.rstrip()[-1:] in tuple(".!?") and not _ENTRY.match(p) and re.search(r"[a-záéíóúãõç]{2,}|\by\b|\be\b", k := pattern_of(p)):
                    found[k] = found.get(k, 0) + 1
        if found:
            yield pd.DataFrame({"pattern": list(found), "n": pd.Series(list(found.values()), dtype="int64")})


def squeezed(text: Column) -> Column:
    """The text without white space and without the marks that follow a cut."""
    bare = F.regexp_replace(text, r"\s+", "")
    return F.regexp_replace(bare, r"(?:\.{2,}|…|\[(?:\.\.\.|…)\]|�)+$", "")


def strict_prefixes(df: DataFrame, key: str, value: str, copies: DataFrame | None = None, length: int = PREFIX, mid_sentence: bool = False) -> DataFrame:
    """Keys of ``df`` whose squeezed value is a strict prefix of a longer value in ``df`` or in the column ``value`` of ``copies``.

    Values of under ``length`` characters don't count. ``mid_sentence``: nor those that the copy only goes on from with a stop. Equal values are folded before the shuffle (partial aggregation by hash),
    so a group of copies of any size sends one row a task.
    """
    mine = df.select(F.col(key).alias("key"), squeezed(F.col(value)).alias("s")).filter(F.length("s") >= length)
    every = mine.select("s") if copies is None else mine.select("s").unionByName(copies.select(F.regexp_replace(F.col(value), r"\s+", "").alias("s")).filter(F.length("s") >= length))
    distinct = every.groupBy("s").agg(F.lit(1).alias("one")).select("s")
    order = Window.partitionBy(F.xxhash64(F.substring("s", 1, length))).orderBy("s")
    hits = distinct.withColumn("next", F.lead("s").over(order)).filter(F.col("next").startswith(F.col("s")))
    if mid_sentence:
        hits = hits.filter(~F.substr("next", F.length("s") + 1, F.lit(1)).rlike(r"[.!?;:)”»\"]"))
    hits = hits.select("s")
    return mine.join(hits, "s", "left_semi").select("key")


def truncated_answers(df: DataFrame, key: str, text: str, kind: str = "kind") -> DataFrame:
    """(kind, key, reason) of values that stop within a word or a sentence; one row per key and kind.

    Reasons: word (the last word is unknown elsewhere), sentence (no whole sentence elsewhere has the pattern), mark (a cut mark within a word or sentence), quote, prefix
    (a longer copy goes on in the middle of a sentence). Null, blank and whole values give no row. Words and patterns are counted over distinct
    values, white space aside: copies of a value are no witnesses for it, so a value is judged alike however many copies it has.
    """
    rows = df.select(F.col(kind).alias("kind"), F.col(key).alias("key"), F.col(text).alias("text")).dropDuplicates(["kind", "key"])
    rows = rows.withColumn("value", F.xxhash64(squeezed(F.col("text"))))
    values = rows.groupBy("value").agg(F.min("text").alias("text")).select("text")
    ends = rows.mapInPandas(_ends, "kind string, key string, value long, state string, pattern string, last_word string").filter("state NOT IN ('whole', 'empty')")
    patterns = values.mapInPandas(_whole_patterns, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n_pattern"))
    # a word counts where something follows it in its value; one that ends a value without a full stop is no witness
    stopped = F.col("text").rlike(r"[\p{L}\p{N})”\"][.!?][\"”»’')\]]*\s*$")
    sure = F.when(stopped, F.col("text")).otherwise(F.regexp_replace("text", r"[\p{L}\p{N}]+[^\p{L}\p{N}]*$", ""))
    inner = F.regexp_extract_all(F.lower(sure), F.lit(r"(\p{L}+|\p{N}[\p{N}.,]*)"), 1)
    known = values.select(F.explode(inner).alias("last_word")).groupBy("last_word").agg(F.count("*").alias("n_word"))
    # the prefix join of patterns: how often whole sentences go on from a pattern, against how often values end in it
    ended = ends.filter("state = 'open'").groupBy("pattern").agg(F.count_distinct("value").alias("n_ended"))
    words = F.split("pattern", " ")
    starts = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.array_join(F.slice(words, 1, i), " "))
    heads = patterns.filter(F.size(words) > 1).select(F.explode(starts).alias("pattern"), "n_pattern")
    longer = heads.join(ended, "pattern", "left_semi").groupBy("pattern").agg(F.sum("n_pattern").alias("n_longer"))
    longer = ended.join(longer, "pattern", "left")
    # the same for the last words of a pattern, for sentences of a build that no whole one has
    def last_of(c: str) -> Column:
        w = F.split(c, " ")
        return F.array_join(F.slice(w, F.greatest(F.size(w) - GRAM + 1, F.lit(1)), GRAM), " ")

    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - GRAM + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, GRAM), " "))
    placed = patterns.select("n_pattern", F.size(words).alias("size"), F.posexplode(grams).alias("at", "tail"))
    at_end = F.col("at") >= F.col("size") - GRAM
    tails = placed.groupBy("tail").agg(F.sum(F.when(at_end, F.col("n_pattern")).otherwise(0)).alias("n_last"), F.sum(F.when(at_end, 0).otherwise(F.col("n_pattern"))).alias("n_within"))
    judged = ends.withColumn("tail", last_of("pattern")).join(patterns, "pattern", "left").join(longer, "pattern", "left").join(tails, "tail", "left").join(known, "last_word", "left")
    judged = judged.join(strict_prefixes(rows.select(F.concat_ws("\u0001", "kind", "key").alias("k"), "text"), "k", "text", mid_sentence=True).select(F.col("key").alias("k"), F.lit(True).alias("is_prefix")).distinct(), F.concat_ws("\u0001", "kind", "key") == F.col("k"), "left")
    word_like = F.col("last_word").rlike(r"^\p{L}+$")
    strange = word_like & (F.coalesce("n_word", F.lit(0)) < 2)
    unseen = F.coalesce("n_pattern", F.lit(0)) < 1
    # values end in this pattern more often than sentences go on from it: whole ones without a full stop
    usual = (F.coalesce("n_ended", F.lit(0)) >= 3) & (F.col("n_ended") > F.coalesce("n_longer", F.lit(0)))
    usual = usual | (F.coalesce(F.col("n_last") > F.col("n_within"), F.lit(False)) & (F.size(F.split("pattern", " ")) > GRAM))
    reason = (
        F.when(strange, "word")
        .when(F.col("state").isin("quote", "mark"), F.col("state"))
        .when((F.col("state") == "open") & unseen & ~usual, "sentence")
        .when((F.col("state") == "open") & F.col("is_prefix"), "prefix")
    )
    return judged.select("kind", "key", reason.alias("reason")).filter(F.col("reason").isNotNull())


def truncated_copies(df: DataFrame, key: str, text: str, source: str, kind: str = "kind", anchor: int = 24) -> DataFrame:
    """(kind, key, reason) of values that should carry the whole of ``source`` and don't, white space aside; one row per key.

    What follows the place where the source begins in the value is looked up by the prefix join among all sources ('prefix': it is
    a strict prefix of a longer copy) and held against the own source ('own'); 'lost' are values cut before that place.
    A null value or source gives no row.
    """
    rows = df.select(F.col(kind).alias("kind"), F.col(key).alias("key"), F.col(text).alias("text"), F.col(source).alias("source"))
    bare, whole = F.regexp_replace("text", r"\s+", ""), F.regexp_replace("source", r"\s+", "")
    lost = rows.filter(~bare.contains(whole)).dropDuplicates(["kind", "key"])
    at = F.instr(bare, F.substring(whole, 1, anchor))
    rest = F.when(at > 0, F.substring(bare, at, F.length(bare)))
    lost = lost.select("kind", "key", F.concat_ws("\u0001", "kind", "key").alias("k"), rest.alias("body"), whole.alias("whole"))
    elsewhere = strict_prefixes(lost, "k", "body", rows.select(F.col("source").alias("body"))).select(F.col("key").alias("k"), F.lit(True).alias("there")).distinct()
    found = lost.join(elsewhere, "k", "left")
    reason = F.when(F.col("there"), "prefix").when(F.col("whole").startswith(squeezed(F.col("body"))), "own").otherwise("lost")
    return found.select("kind", "key", reason.alias("reason"))


def truncation_rates(found: DataFrame, rows: DataFrame, key: str, source: str) -> DataFrame:
    """(source, n, n_truncated, share) over the unique keys of ``rows``; null sources are a group of their own."""
    unique = rows.select(F.col(key).alias("key"), F.col(source).alias("source")).distinct()
    hit = found.select("key").distinct().withColumn("hit", F.lit(1))
    out = unique.join(hit, "key", "left").groupBy("source").agg(F.count("*").alias("n"), F.count("hit").alias("n_truncated"))
    return out.withColumn("share", F.col("n_truncated") / F.col("n"))
