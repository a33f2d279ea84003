"""Page layout: rows of page items, repeated headers and footers, flat text, and the place of a chunk on its pages.

Items are rows (document_id, page, item, str, x, y, width, height) with coordinates in 0..1.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx

EDGE, REPEATS = 0.12, 3
OVERLAP = 0.4
LINE_STEP, WORD_GAP = 0.5, 0.002
MIN_TEXT, MAX_OCR_PAGES = 20, 60


def _row_of(rows: list[list[float]], top: float, bottom: float) -> int:
    """Number of the first row that an item overlaps by more than 40 % of the smaller height; a new row where there is none."""
    for n, (lo, hi) in enumerate(rows):
        smaller = min(bottom - top, hi - lo)
        if smaller > 0 and (min(bottom, hi) - max(top, lo)) / smaller > OVERLAP:
            rows[n] = [min(lo, top), max(hi, bottom)]
            return n
    rows.append([top, bottom])
    return len(rows) - 1


def cluster(tops: list[float], bottoms: list[float]) -> list[int]:
    """Row numbers of items in reading order."""
    rows: list[list[float]] = []
    return [_row_of(rows, t, b) for t, b in zip(tops, bottoms)]


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    # items come sorted by page and reading order; a page may go on in the next batch
    page, rows, place = None, [], 0
    for pdf in batches:
        numbers, places = [], []
        for d, p, y, h in zip(pdf["document_id"], pdf["page"], pdf["y"], pdf["height"]):
            if (d, p) != page:
                page, rows, place = (d, p), [], 0
            numbers.append(_row_of(rows, y, y + h))
            places.append(place)
            place += 1
        yield pdf.assign(row_no=pd.Series(numbers, dtype="int32", index=pdf.index), place=pd.Series(places, dtype="int32", index=pdf.index))


def page_rows(items: DataFrame) -> DataFrame:
    """Items with their row (``row_no``) and place in reading order: a greedy matching that walks sorted pages, one at a time."""
    cols = "document_id string, page int, item int, str string, x double, y double, width double, height double"
    narrow = items.select(*[c.split(" ")[0] for c in cols.split(", ")])
    ordered = narrow.repartition("document_id", "page").sortWithinPartitions("document_id", "page", "y", "x", "item")
    return ordered.mapInPandas(_rows, cols + ", row_no int, place int")


def row_table(rows: DataFrame) -> DataFrame:
    """(document_id, page, row_no, min_x, min_y, max_x, max_y, text): one line a row of items."""
    ordered = F.array_sort(F.collect_list(F.struct("place", "str")))
    return rows.groupBy("document_id", "page", "row_no").agg(
        F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max(F.col("x") + F.col("width")).alias("max_x"), F.max(F.col("y") + F.col("height")).alias("max_y"),
        F.array_join(F.transform(ordered, lambda v: v["str"]), " ").alias("text"),
    )


def repeated_rows(table: DataFrame) -> DataFrame:
    """(document_id, key) of edge rows that stand on three pages or more, counted once a page."""
    edge = table.filter((F.col("max_y") <= EDGE) | (F.col("min_y") >= 1 - EDGE)).select("document_id", "page", tx.squeeze(F.col("text")).alias("key"))
    return edge.filter("key != ''").distinct().groupBy("document_id", "key").agg(F.count("*").alias("pages")).filter(F.col("pages") >= REPEATS).select("document_id", "key")


def separator(prev: Column, prev_x: Column, prev_y: Column, prev_w: Column, prev_h: Column, text: Column, x: Column, y: Column) -> Column:
    """What stands between two items: nothing, a line break for a vertical step, a blank for a gap."""
    none = prev.isNull() | prev.endswith(" ") | prev.endswith("\n") | text.startswith(" ")
    return F.when(none, "").when(F.abs(y - prev_y) > prev_h * LINE_STEP, "\n").when(x - (prev_x + prev_w) > WORD_GAP, " ").otherwise("")


def page_texts(items: DataFrame, sanitize: bool = True) -> DataFrame:
    """(document_id, page, text): the text of each page by rows, repeated headers and footers left out."""
    rows = page_rows(items)
    table = row_table(rows)
    if sanitize:
        noise = repeated_rows(table)
        kept = table.withColumn("key", tx.squeeze(F.col("text"))).join(noise, ["document_id", "key"], "left_anti")
    else:
        kept = table
    order = kept.select("document_id", "page", "row_no", F.col("min_y"))
    rows = rows.join(order, ["document_id", "page", "row_no"])
    w = Window.partitionBy("document_id", "page", "row_no").orderBy("place")
    prev = [F.lag(c).over(w) for c in ("str", "x", "y", "width", "height")]
    rows = rows.withColumn("sep", separator(*prev, F.col("str"), F.col("x"), F.col("y")))
    line = rows.groupBy("document_id", "page", "row_no").agg(
        F.min("min_y").alias("top"), F.min("place").alias("first"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat("sep", "str").alias("t")))), lambda v: v["t"]), "").alias("t"),
    )
    page = line.groupBy("document_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "first", "t"))), lambda v: F.concat(v["t"], F.lit("\n"))), "").alias("text"))
    return page


def flat_text(pages: DataFrame) -> DataFrame:
    """(document_id, text): pages without trailing white space, a blank line between them."""
    ordered = F.array_sort(F.collect_list(F.struct("page", F.regexp_replace("text", r"\s+$", "").alias("t"))))
    return pages.groupBy("document_id").agg(F.array_join(F.transform(ordered, lambda v: v["t"]), "\n\n").alias("text"))


def needs_ocr(text: Column) -> Column:
    """Whether a text layer holds too little to be used."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", "")) < MIN_TEXT


def page_spans(pages: DataFrame) -> DataFrame:
    """(document_id, page, start, end): where each page stands in the flat text, by a running sum of lengths."""
    n = pages.select("document_id", "page", F.length(F.regexp_replace("text", r"\s+$", "")).alias("n"))
    w = Window.partitionBy("document_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("n") + 2).over(w), F.lit(0))
    return n.select("document_id", "page", start.alias("start"), (start + F.col("n")).alias("end"))


def pages_of_chunks(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, chunk_id, page, local_start, local_end): the parts of chunk ranges [start, end) on the pages they touch."""
    spans = page_spans(pages).select("document_id", "page", F.col("start").alias("p0"), F.col("end").alias("p1"))
    met = chunks.select("document_id", "chunk_id", "start", "end").join(spans, "document_id").filter((F.col("start") < F.col("p1")) & (F.col("end") > F.col("p0")))
    return met.select("document_id", "chunk_id", "page", (F.greatest("start", "p0") - F.col("p0")).alias("local_start"), (F.least("end", "p1") - F.col("p0")).alias("local_end"))


def find_squeezed(haystack: str, needle: str) -> tuple[int, int] | None:
    """Range of the first occurrence without regard to white space."""
    places = [i for i, c in enumerate(haystack) if not c.isspace()]
    body = "".join(haystack[i] for i in places)
    want = "".join(needle.split())
    at = body.find(want) if want else -1
    return None if at < 0 else (places[at], places[at + len(want) - 1] + 1)


def locate_lines(pages: list[tuple[int, str]], chunk: str) -> list[tuple[int, int, int]]:
    """(page, start, end) of each line of a chunk, looked for page by page in order; lines that aren't found are left out."""
    out, cursor = [], 0
    for line in (x.strip() for x in chunk.split("\n")):
        if not line:
            continue
        for k in range(cursor, len(pages)):
            hit = find_squeezed(pages[k][1], line)
            if hit:
                out.append((pages[k][0], *hit))
                cursor = k
                break
    return out


def locate_by_content(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, chunk_id, page, start, end) of the lines of chunks on the pages of their document.

    A chunk of which no line is found has no row here; its offsets decide then (``pages_of_chunks``).
    """
    packed = pages.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("pages"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, c, text, ps in zip(pdf["document_id"], pdf["chunk_id"], pdf["text"], pdf["pages"]):
                rows += [(d, c, *r) for r in locate_lines([(p["page"], p["text"]) for p in ps], text or "")]
            yield pd.DataFrame(rows, columns=["document_id", "chunk_id", "page", "start", "end"])

    return chunks.join(packed, "document_id").select("document_id", "chunk_id", "text", "pages").mapInPandas(run, "document_id string, chunk_id string, page int, start int, end int")


def row_boxes(matched: DataFrame, by: list[str]) -> DataFrame:
    """(by, row_no, x, y, width, height): items united to one box a row."""
    box = matched.groupBy(*by, "row_no").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("width")).alias("x1"), F.max(F.col("y") + F.col("height")).alias("y1"))
    return box.select(*by, "row_no", "x", "y", (F.col("x1") - F.col("x")).alias("width"), (F.col("y1") - F.col("y")).alias("height"))


def occurrences(lines: DataFrame, needle: str) -> DataFrame:
    """(document_id, line_no, at): every occurrence of a string in lines, without case, not overlapping; offsets from 0."""
    low = F.lower(F.lit(needle))
    parts = F.split(F.lower(F.col("line")), F.lit("\\Q" + needle.lower() + "\\E"), -1)
    sums = F.aggregate(F.slice(parts, 1, F.size(parts) - 1), F.array().cast("array<int>"), lambda acc, p: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)) + F.length(low), F.lit(0)) + F.length(p))))
    found = lines.filter(F.lower("line").contains(needle.lower())) if needle else lines.limit(0)
    return found.select("document_id", "line_no", F.explode(sums).alias("at"))
