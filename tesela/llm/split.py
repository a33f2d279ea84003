"""Splitting oversized texts and files at natural boundaries, by ranges with halos.

Every text is seen as ranges of ``RANGE`` characters. Each range, read with a halo on both sides, names the boundaries that lie
in it; the boundary tables are put together in order of the offsets, walked once to choose the cuts, and the pieces are
emitted by offset. A walk holds one window of boundaries, never a whole text or table.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE, HALO = 1 << 16, 512
#: Strength of a boundary: a piece ends rather at a stronger one.
ARTICLE, PARAGRAPH, LINE, SENTENCE, WORD = 5, 4, 3, 2, 1
_ARTICLE = re.compile(r"(?:(?<=\n)|(?<=\A))(?=[ \t]*(?:art[íi]culo|art\.|article|section|cap[íi]tulo|t[íi]tulo|libro|anexo|cl[áa]usula|secci[óo]n)\s+[\divxlcº°]+)", re.I)
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n\s*")
_LINE = re.compile(r"\n")
_SENTENCE = re.compile(r"[.!?…:;][\"”»’')\]]*\s+")
_SPACE = re.compile(r"\s+")
_GRID = 64


def boundaries(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """(offset, strength) of the places in [start, end) where a piece may end; a halo around makes the ranges agree.

    Of the word ends only the last of each ``_GRID`` characters is named: enough to cut within a window of that size.
    """
    found: dict[int, int] = {}
    for pattern, strength in ((_SPACE, WORD), (_SENTENCE, SENTENCE), (_LINE, LINE), (_PARAGRAPH, PARAGRAPH), (_ARTICLE, ARTICLE)):
        words: dict[int, int] = {}
        for m in pattern.finditer(text, max(0, start - HALO), min(len(text), end + HALO)):
            at = m.end()
            if start <= at < end and at:
                if strength == WORD:
                    words[at // _GRID] = at
                elif found.get(at, 0) < strength:
                    found[at] = strength
        for at in words.values():
            found[at] = WORD
    return sorted(found.items())


class Walker:
    """Chooses the cuts of one text from its boundaries in order; holds those of the open window only."""

    def __init__(self, limit: int, overlap: int):
        if not 0 <= overlap < limit // 2:
            raise ValueError("the overlap must be under half of the limit")
        self.limit, self.overlap = limit, overlap
        self.begin, self.window = 0, []

    def _last(self) -> int:
        """Where the piece that begins here must end, the repeated characters in front counted."""
        return self.begin + self.limit - (self.overlap if self.begin else 0)

    def _cut(self, end: int) -> tuple[int, int]:
        low = self.begin + (end - self.begin) // 2
        near = [b for b in self.window if low < b[0] <= end] or [b for b in self.window if self.begin < b[0] <= end]
        at = max(near, key=lambda b: (b[1], b[0]))[0] if near else end
        piece = (max(0, self.begin - self.overlap) if self.begin else 0, at)
        self.begin = at
        self.window = [b for b in self.window if b[0] > at]
        return piece

    def feed(self, at: int, strength: int) -> Iterator[tuple[int, int]]:
        while at > self._last():
            yield self._cut(self._last())
        self.window.append((at, strength))

    def finish(self, length: int) -> Iterator[tuple[int, int]]:
        while length > self._last():
            yield self._cut(self._last())
        if length > self.begin:
            yield (max(0, self.begin - self.overlap) if self.begin else 0, length)


def cuts(bounds: Iterable[tuple[int, int]], length: int, limit: int, overlap: int) -> list[tuple[int, int]]:
    """[start, end) of the pieces of one text, the repeated characters included."""
    w, out = Walker(limit, overlap), []
    for at, strength in bounds:
        out.extend(w.feed(at, strength))
    out.extend(w.finish(length))
    return out


def _detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keys, ats, strengths = [], [], []
        for key, begin, lead, body, size in zip(pdf["key"], pdf["begin"], pdf["lead"], pdf["body"], pdf["size"]):
            for at, s in boundaries(body, lead, lead + size):
                keys.append(key)
                ats.append(begin + at - lead)
                strengths.append(s)
        if keys:
            yield pd.DataFrame({"key": keys, "at": pd.Series(ats, dtype="int64"), "strength": pd.Series(strengths, dtype="int32")})


def _walk(limit_of: dict[str, int] | None, limit: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come sorted by key and offset; strength 0 is the end of a text
        key, walker, number = None, None, 0
        for pdf in batches:
            out: list[tuple] = []
            for k, at, s, group in zip(pdf["key"], pdf["at"], pdf["strength"], pdf["kind"]):
                if k != key:
                    key, number = k, 0
                    walker = Walker(limit_of[group] if limit_of else limit, overlap)
                for a, b in walker.finish(at) if s == 0 else walker.feed(at, s):
                    out.append((k, number, a, b))
                    number += 1
            yield pd.DataFrame(out, columns=["key", "piece", "start", "end"])

    return run


def split_records(df: DataFrame, key: str, text: str, limit: int | None = None, overlap: int = 150, kind: str | None = None, limits: dict[str, int] | None = None, range_chars: int = RANGE) -> DataFrame:
    """(key, piece, start, end, piece_text) of the texts above the limit in characters (code points).

    ``limits`` gives a limit for each value of the column ``kind``; otherwise ``limit`` holds for all. Each piece is at most
    the limit long and, but for the first, repeats the last ``overlap`` characters of the one before. Texts of at most the
    limit, null and empty ones give no row. Keys must be unique: rows delivered twice are made unique by their key.
    """
    group = F.col(kind) if kind else F.lit("")
    cap = F.lit(limit) if limits is None else F.element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), group)
    big = df.select(F.col(key).cast("string").alias("key"), group.alias("kind"), F.col(text).alias("text"), F.char_length(text).alias("n")).filter(F.col("n") > cap).dropDuplicates(["key", "kind"])
    big = big.withColumn("key", F.concat_ws("\u0001", "kind", "key"))
    ranges = big.select("key", "text", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / range_chars).cast("int"))).alias("r"))
    begin = F.col("r") * range_chars
    lead = F.least(F.lit(HALO), begin)
    size = F.least(F.lit(range_chars), F.col("n") - begin)
    ranges = ranges.select("key", begin.alias("begin"), lead.alias("lead"), size.alias("size"), F.substring(F.col("text"), begin - lead + 1, lead + size + HALO).alias("body"))
    found = ranges.mapInPandas(_detect, "key string, at long, strength int")
    ends = big.select("key", F.col("n").cast("long").alias("at"), F.lit(0).alias("strength"))
    marks = found.unionByName(ends).withColumn("kind", F.split("key", "\u0001")[0])
    pieces = (
        marks.repartition("key")
        .sortWithinPartitions("key", "at", F.desc("strength"))
        .mapInPandas(_walk(limits, limit or 0, overlap), "key string, piece int, start long, end long")
    )
    emitted = pieces.join(big.select("key", "kind", "text"), "key")
    body = F.substring(F.col("text"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    return emitted.select("kind", F.split("key", "\u0001")[1].alias("key"), "piece", "start", "end", body.alias("piece_text"))


# --- giant files: byte ranges ---------------------------------------------------------------------------------------------


def _file_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Boundaries of a byte range in UTF-8 bytes; a range is read with its halo, the file never as a whole."""
    for pdf in batches:
        keys, ats, strengths = [], [], []
        for path, begin, size in zip(pdf["key"], pdf["begin"], pdf["size"]):
            lead = min(HALO, begin)
            with open(path, "rb") as f:
                f.seek(begin - lead)
                raw = f.read(lead + size + HALO)
            skip = 0
            while skip < min(4, len(raw)) and (raw[skip] & 0xC0) == 0x80:
                skip += 1
            body = raw[skip:].decode("utf-8", errors="replace") if _whole(raw[skip:]) else raw[skip:].decode("utf-8", errors="ignore")
            offset, last = begin - lead + skip, 0
            for at, s in boundaries(body, 0, len(body)):
                offset += len(body[last:at].encode("utf-8"))
                last = at
                if begin <= offset < begin + size:
                    keys.append(path)
                    ats.append(offset)
                    strengths.append(s)
        if keys:
            yield pd.DataFrame({"key": keys, "at": pd.Series(ats, dtype="int64"), "strength": pd.Series(strengths, dtype="int32")})


def _whole(raw: bytes) -> bool:
    try:
        raw.decode("utf-8")
        return True
    except UnicodeDecodeError:
        return False


def _read_piece(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = []
        for path, start, end in zip(pdf["key"], pdf["start"], pdf["end"]):
            with open(path, "rb") as f:
                f.seek(start)
                raw = f.read(end - start)
            while raw and (raw[0] & 0xC0) == 0x80:  # an overlap may begin within a character
                raw = raw[1:]
            texts.append(raw.decode("utf-8", errors="ignore"))
        yield pdf.assign(piece_text=texts)


def split_files(spark: SparkSession, files: list[tuple[str, int]], limit: int, overlap: int = 150, range_bytes: int = 8 << 20) -> DataFrame:
    """(path, piece, start, end, piece_text) of (path, length in bytes) files on a file system that all workers share.

    Limit and overlap count bytes here. Each range is a task of its own, so one giant file is spread over the cluster;
    the pieces are read again by offset. Empty files give no row.
    """
    rows = spark.createDataFrame([(p, int(n)) for p, n in files], "key string, n long").filter("n > 0")
    ranges = rows.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / range_bytes))).alias("r"), "n")
    ranges = ranges.select("key", (F.col("r") * range_bytes).alias("begin"), F.least(F.lit(range_bytes).cast("long"), F.col("n") - F.col("r") * range_bytes).alias("size"))
    found = ranges.repartition("key", "begin").mapInPandas(_file_ranges, "key string, at long, strength int")
    marks = found.unionByName(rows.select("key", F.col("n").alias("at"), F.lit(0).alias("strength"))).withColumn("kind", F.lit(""))
    pieces = marks.repartition("key").sortWithinPartitions("key", "at", F.desc("strength")).mapInPandas(_walk(None, limit, overlap), "key string, piece int, start long, end long")
    read = pieces.repartition("key", "piece").mapInPandas(_read_piece, "key string, piece int, start long, end long, piece_text string")
    return read.withColumnRenamed("key", "path")
