"""Pluggable models as column builders, with deterministic stand-ins. A model is loaded once a worker and fed in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .structure import _word


def hashed_vector(text: str, dims: int) -> list[float]:
    """Unit vector of hashed word counts: the deterministic embedder of tests."""
    v = np.zeros(dims)
    word = ""
    for c in (text or "").lower() + " ":
        if _word(c) or c.isalpha():
            word += c
        elif word:
            h = xxhash.xxh3_64_intdigest(word)
            v[h % dims] += 1.0 if h >> 63 else -1.0
            word = ""
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


def embedder(load: Callable[[], Callable[[list[str]], list[list[float]]]] | None = None, dims: int = 64, batch: int = 8) -> Callable[[Column], Column]:
    """Builds an embedding column; ``load`` gives a function over a batch of texts. A failing text gives null."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load() if load else (lambda texts: [hashed_vector(t, dims) for t in texts])
        for s in parts:
            out: list = []
            for i in range(0, len(s), batch):
                texts = s.iloc[i : i + batch].tolist()
                try:
                    out += [v[:dims] for v in model(texts)]
                except Exception:
                    out += [None] * len(texts)
            yield pd.Series(out)

    return run


def reranker(load: Callable[[], Callable[[list[tuple[str, str]]], list[list[float]]]] | None = None) -> Callable[[Column, Column], Column]:
    """Builds a column of logits for (query, passage); the stand-in counts shared words."""

    def shared(pairs: list[tuple[str, str]]) -> list[list[float]]:
        return [[float(len(set(q.lower().split()) & set(p.lower().split())))] for q, p in pairs]

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load() if load else shared
        for q, p in parts:
            yield pd.Series(model(list(zip(q.fillna(""), p.fillna("")))))

    return run


def wait_before(attempt: int, error: Exception, base: float = 1.0, limited: float = 10.0, jitter: float = 0.0) -> float:
    """Seconds to wait after a failed attempt (from 1): doubling, or what a rate limit asks for. ``jitter`` in 0..1 spreads workers."""
    said = str(error)
    if any(x in said for x in ("429", "rate limit", "Too Many Requests", "RateLimited")):
        headers = {str(k).lower(): v for k, v in (getattr(error, "headers", None) or {}).items()}
        try:
            asked = float(headers.get("retry-after", 0))
        except ValueError:
            asked = 0.0
        return (asked if asked > 0 else limited) + 5.0 * jitter
    return base * 2 ** (attempt - 1) + jitter


def persistent(model: Callable, tries: int = 3, base: float = 1.0, limited: float = 10.0) -> Callable:
    """A model that is called again when it fails, for use inside the builders above; the last failure is raised."""
    import random
    import time

    def call(batch):
        for attempt in range(1, tries + 1):
            try:
                return model(batch)
            except Exception as e:
                if attempt == tries:
                    raise
                time.sleep(wait_before(attempt, e, base, limited, random.random()))

    return call
