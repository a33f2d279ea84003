"""Sources and sinks: files of text, markup and word processors, tables, and the write path."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SUPPORTED = ("txt", "md", "xml", "docx", "pdf")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): whole text files as UTF-8."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(query_text): one query a line, blank lines dropped."""
    return spark.read.text(path).select(F.trim("value").alias("query_text")).filter("query_text != ''")


def docx_text(data: bytes) -> str:
    """Raw text of a word-processor file: its paragraphs, a blank line between them."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in root.iter(f"{_W}p"):
        parts = []
        for node in p.iter():
            if node.tag == f"{_W}t":
                parts.append(node.text or "")
            elif node.tag == f"{_W}tab":
                parts.append("\t")
            elif node.tag in (f"{_W}br", f"{_W}cr"):
                parts.append("\n")
        out.append("".join(parts))
    return "\n\n".join(out)


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts, errors = [], []
        for kind, data in zip(pdf["kind"], pdf["content"]):
            text, error = None, None
            try:
                if kind in ("txt", "md", "xml"):
                    text = data.decode("utf-8", errors="replace")
                elif kind == "docx":
                    text = docx_text(data)
                else:
                    error = f"unsupported kind of file: {kind}"
            except Exception as e:
                error = repr(e)[:300]
            texts.append(text)
            errors.append(error)
        yield pd.DataFrame({"path": pdf["path"], "kind": pdf["kind"], "text": texts, "error": errors})


def read_documents(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, kind, content, error): files by extension. XML comes out as its text nodes; pages of PDF come as a table of items
    (``operators.layout``), so a PDF gives an error here, as does an unknown kind."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    text = files.select("path", kind.alias("kind"), "content").mapInPandas(_extract, "path string, kind string, text string, error string")
    return text.select("path", "kind", F.when(F.col("kind") == "xml", tx.strip_markup(F.col("text"))).otherwise(F.col("text")).alias("content"), "error")


def storage_key(created_at: Column, name: Column, prefix: str = "documents/") -> Column:
    """Key under which a file is stored: prefix, milliseconds, safe name."""
    return F.concat(F.lit(prefix), F.unix_millis(created_at).cast("string"), F.lit("-"), tx.safe_name(name))


def query_table(spark: SparkSession, rows: list[tuple[str, str, list[float]]]) -> DataFrame:
    """(query_id, query_text, query_vector) from Python values."""
    if any(not (text or "").strip() for _, text, _ in rows) or not rows:
        raise ValueError("at least one query, and none of them blank")
    return spark.createDataFrame(rows, "query_id string, query_text string, query_vector array<double>")


def append(tables: dict[str, DataFrame], root: str, partition_by: dict[str, list[str]] | None = None) -> None:
    """Appends each table to its folder, children after parents. Ids are hashes, so a batch that runs twice is made unique when
    it is read (``operators.inventory.unique``)."""
    for name, df in tables.items():
        writer = df.write.mode("append")
        keys = (partition_by or {}).get(name)
        (writer.partitionBy(*keys) if keys else writer).parquet(f"{root}/{name}.parquet")


def replace_table(df: DataFrame, path: str) -> None:
    """Overwrites a table by way of a second folder, so that a plan may read the table that it replaces."""
    spark = df.sparkSession
    staged = re.sub(r"/+$", "", path) + ".staged"
    df.write.mode("overwrite").parquet(staged)
    spark.read.parquet(staged).write.mode("overwrite").parquet(path)
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(staged)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
