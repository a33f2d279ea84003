"""Held-out passages in training text: winnowing fingerprints of word k-grams, joined and extended to exact spans."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small

#: A shared span of SPAN words is found for sure: SPAN = K + WINDOW - 1.
SPAN, K = 16, 8
WINDOW = SPAN - K + 1
_WORD = re.compile(r"[^\W_]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Words without case and accents: compatibility decomposition, combining marks removed, runs of letters and digits."""
    if not text:
        return []
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return _WORD.findall(text.casefold())


def word_codes(words: list[str], seen: dict[str, int]) -> np.ndarray:
    """64-bit codes of words; ``seen`` keeps those of a batch."""
    out = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        c = seen.get(w)
        if c is None:
            c = seen[w] = xxhash.xxh3_64_intdigest(w)
        out[i] = c
    return out


def gram_hashes(codes: np.ndarray, k: int = K) -> np.ndarray:
    """Hash of each k-gram; equal grams have equal hashes wherever they stand."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = (h ^ codes[j : j + n]) * _MULT
        h ^= h >> np.uint64(29)
    return h


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions kept: the rightmost minimum of every window of ``window`` consecutive hashes (one window if there are fewer)."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.int64)
    w = min(window, n)
    view = np.lib.stride_tricks.sliding_window_view(hashes, w)
    return np.unique(np.arange(n - w + 1) + (w - 1 - np.argmin(view[:, ::-1], axis=1)))


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: dict[str, int] = {}
    for pdf in batches:
        if len(seen) > 200_000:
            seen.clear()
        ids, fps, pos = [], [], []
        for key, text in zip(pdf["key"], pdf["text"]):
            h = gram_hashes(word_codes(words_of(text), seen))
            at = winnow(h)
            if len(at):
                ids.append(np.full(len(at), key))
                fps.append(h[at].view(np.int64))
                pos.append(at)
        if ids:
            yield pd.DataFrame({"key": np.concatenate(ids), "fp": np.concatenate(fps), "pos": np.concatenate(pos).astype(np.int32)})


def fingerprints(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, fp, pos): the winnowed fingerprints of every text. Texts of under K words have none; null and empty texts neither."""
    return df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInPandas(_fingerprints, "key long, fp long, pos int")


def _extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Longest common span along each diagonal that a joined fingerprint names."""
    seen: dict[str, int] = {}
    for pdf in batches:
        longest = np.zeros(len(pdf), np.int32)
        for i, (a, b, diagonals) in enumerate(zip(pdf["doc_text"], pdf["item_text"], pdf["diagonals"])):
            x, y = word_codes(words_of(a), seen), word_codes(words_of(b), seen)
            for d in set(int(v) for v in diagonals):  # d = position in the document - position in the item
                lo, hi = max(0, d), min(len(x), len(y) + d)
                same = np.concatenate(([False], x[lo:hi] == y[lo - d : hi - d], [False]))
                ends = np.flatnonzero(same[1:] != same[:-1])
                if len(ends):
                    longest[i] = max(longest[i], int((ends[1::2] - ends[::2]).max()))
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "item_id": pdf["item_id"], "longest_span": longest})


def leaked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """(doc_id, item_id, longest_span) of all pairs that share at least ``span`` consecutive words.

    Items are broadcast where Catalyst's bound of their size allows it, else the fingerprints are joined by shuffle.
    Only fingerprints that items hold leave the corpus scan; the texts of the hit documents are read again for the extension.
    """
    item_fps = fingerprints(items, item_id, text).select(F.col("key").alias("item_id"), "fp", F.col("pos").alias("item_pos"))
    fps = fingerprints(docs, doc_id, text).select(F.col("key").alias("doc_id"), "fp", F.col("pos").alias("doc_pos"))
    is_small = small(items.select(item_id, text))
    side = F.broadcast(item_fps) if is_small else item_fps
    hits = fps.join(side, "fp").groupBy("doc_id", "item_id").agg(F.collect_set(F.col("doc_pos") - F.col("item_pos")).alias("diagonals"))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("doc_text"))
    item_texts = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("item_text"))
    both = hits.join(texts, "doc_id").join(F.broadcast(item_texts) if is_small else item_texts, "item_id")
    spans = both.select("doc_id", "item_id", "doc_text", "item_text", "diagonals").mapInPandas(_extend, "doc_id long, item_id long, longest_span int")
    return spans.filter(F.col("longest_span") >= span)
