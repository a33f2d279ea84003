"""Chunking of documents in batches: parents and children with offsets, lines and structural paths."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import structure as st
from ..functions import text as tx

PIECES = (
    "document_id string, kind string, piece_index int, parent_index int, text string, start_char int, end_char int, start_line int, "
    "end_line int, context_path string, extended_text string, first_child int, last_child int, strategy string, error string"
)


def _split(overlap: int, sizes: dict[str, int], size_for: Callable[[str], int] | None):
    def one(key: str, text: str, mime: str, name: str) -> Iterator[tuple]:
        split, index = st.split_document(text, st.STRATEGIES[name], mime, overlap, size_for, **sizes)
        starts = [a for a, _ in st.line_spans(text)] or [0]
        for p in split.parents:
            yield key, "parent", p.index, None, p.text, None, None, None, None, None, None, p.first_child, p.last_child, name, None
        for c in split.children:
            a, b = c.start, c.end
            if index is not None:
                a, b = st.original_offset(index, a, len(text)), st.original_offset(index, b, len(text))
            yield key, "child", c.index, c.parent, c.text, a, b, st.line_of(starts, a), st.line_of(starts, max(a, b - 1)), c.path, c.extended, None, None, name, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in PIECES.split(", ")]
        for pdf in batches:
            rows: list[tuple] = []
            for key, text, mime, name in zip(pdf["key"], pdf["text"], pdf["mime"], pdf["strategy"]):
                try:
                    rows += one(key, text or "", mime or "", name)
                except Exception as e:  # a failing document doesn't stop the others
                    rows.append((key, "failed", 0, None, None, None, None, None, None, None, None, None, None, name, repr(e)[:500]))
            out = pd.DataFrame(rows, columns=names)
            ints = ["piece_index", "parent_index", "start_char", "end_char", "start_line", "end_line", "first_child", "last_child"]
            yield out.astype({c: "Int32" for c in ints})

    return run


def chunk_documents(df: DataFrame, key: str = "id", text: str = "content", mime: str | None = "mime_type", strategy: str = "auto", overlap: int = 80, size_for: Callable[[str], int] | None = None, **sizes: int) -> DataFrame:
    """Pieces of every document (see ``PIECES``). 'auto' takes the strategy from the content.

    A document is one row and stays in one task; other columns, vectors above all, don't pass through Python. Null texts give no
    piece; a document that fails gives one row of kind 'failed'.
    """
    chosen = tx.strategy(tx.strategy_score(F.col(text))) if strategy == "auto" else F.lit(strategy)
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), (F.col(mime) if mime else F.lit("")).alias("mime"), chosen.alias("strategy")).filter("text IS NOT NULL")
    return rows.mapInPandas(_split(overlap, sizes, size_for), PIECES)


def ingest_tables(documents: DataFrame, pieces: DataFrame, embed: Callable | None = None) -> dict[str, DataFrame]:
    """The parent and child tables of chunked documents. Ids are hashes of natural keys, so a task that runs again gives the same."""

    def ident(*cols) -> F.Column:
        return F.sha2(F.concat_ws("/", *cols), 256)

    titles = documents.select(F.col("id").alias("document_id"), "title")
    parents = pieces.filter("kind = 'parent'").select(
        ident("document_id", F.lit("parent"), "piece_index").alias("id"), "document_id", F.col("piece_index").alias("parent_index"), F.col("text").alias("content"),
        F.col("first_child").alias("start_child_index"), F.col("last_child").alias("end_child_index"),
    )
    children = pieces.filter("kind = 'child'").join(titles, "document_id")
    location = F.struct("start_char", "end_char", "start_line", "end_line")
    body = F.coalesce("extended_text", "text")
    out = children.select(
        ident("document_id", F.lit("child"), "piece_index").alias("id"), "document_id", F.col("piece_index").alias("paragraph_index"), F.col("text").alias("raw_content"),
        tx.context_text(F.col("title"), F.col("context_path"), body).alias("contextualized_text"), F.struct(location.alias("location"), "context_path").alias("metadata"),
        ident("document_id", F.lit("parent"), "parent_index").alias("parent_chunk_id"),
    )
    if embed is not None:
        out = out.withColumn("embedding", embed(F.col("contextualized_text"))).filter("embedding IS NOT NULL")
    return {"document_parent_chunks": parents, "document_paragraphs": out}


def boundary_table(df: DataFrame, key: str = "id", text: str = "content", kinds: set[str] | None = None) -> DataFrame:
    """(document_id, start, end, kind, label) of all structural boundaries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *b) for k, t in zip(pdf["key"], pdf["text"]) for b in st.boundaries(t or "", kinds)]
            yield pd.DataFrame(rows, columns=["document_id", "start", "end", "kind", "label"])

    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(run, "document_id string, start int, end int, kind string, label string")


def lines(df: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """(document_id, line_no, start, line): the lines of every text with their offsets, computed within the row."""
    parts = F.split(F.col(text), "\n")
    rows = df.select(F.col(key).alias("document_id"), parts.alias("parts"))
    offsets = F.aggregate("parts", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x) + 1)))
    zipped = rows.select("document_id", F.posexplode(F.arrays_zip(F.col("parts").alias("line"), F.slice(offsets, 1, F.size("parts")).alias("start"))).alias("no", "x"))
    return zipped.select("document_id", (F.col("no") + 1).alias("line_no"), F.col("x.start").alias("start"), F.col("x.line").alias("line"))


def outline_table(df: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """(document_id, start, level, rank, label) of the lines that open a level, by expressions only."""
    level = rank = label = None
    for name, number, pattern in st.LEVELS:
        java = "(?iu)" + pattern.pattern
        hit = F.col("line").rlike(java)
        found = F.trim(F.concat(F.lit(name.upper() + " "), F.upper(F.regexp_extract("line", java, 1)))) if pattern.groups else F.lit(name.upper())
        level = F.when(hit, name) if level is None else level.when(hit, name)
        rank = F.when(hit, number) if rank is None else rank.when(hit, number)
        label = F.when(hit, found) if label is None else label.when(hit, found)
    return lines(df, key, text).select("document_id", "start", level.alias("level"), rank.alias("rank"), label.alias("label")).filter("level IS NOT NULL")


def paths_at(places: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds ``context_path`` to places (document_id, at): as-of lookup of the last open node of each rank.

    Nodes and places are sorted together by offset; for each rank the last node counts if no higher one came after it.
    """
    n = nodes.select("document_id", F.col("start").alias("at"), F.lit(0).alias("kind"), "rank", "label")
    p = places.select("document_id", "at").distinct().withColumns({"kind": F.lit(1), "rank": F.lit(None).cast("int"), "label": F.lit(None).cast("string")})
    w = Window.partitionBy("document_id").orderBy("at", "kind")
    both = n.unionByName(p)
    for r in range(1, 8):
        both = both.withColumn(f"n{r}", F.last(F.when(F.col("rank") == r, F.struct("at", "label")), ignorenulls=True).over(w))
    parts = []
    for r in range(1, 8):
        higher = [F.coalesce(F.col(f"n{q}.at"), F.lit(-1)) for q in range(1, r)]
        open_ = F.col(f"n{r}.at") > (F.greatest(*higher) if len(higher) > 1 else higher[0] if higher else F.lit(-1))
        parts.append(F.when(open_, F.col(f"n{r}.label")))
    found = both.filter("kind = 1").select("document_id", "at", F.concat_ws(" > ", *parts).alias("context_path"))
    return places.join(found, ["document_id", "at"])
