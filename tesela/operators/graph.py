"""Graph of documents and fragments: nodes, edges, similarity relations, query heat."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as vc
from .ordering import positions


def nodes(documents: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(node_id, label, kind, document_id): documents with titles of at most 22 characters, fragments as F1, F2, ..."""
    title = F.when(F.length("title") > 22, F.concat(F.substring("title", 1, 22), F.lit("…"))).otherwise(F.col("title"))
    docs = documents.select(F.concat(F.lit("doc-"), "id").alias("node_id"), title.alias("label"), F.lit("doc").alias("kind"), F.col("id").alias("document_id"))
    label = F.concat(F.lit("F"), (F.col("paragraph_index") + 1).cast("string"))
    frags = paragraphs.select(F.concat(F.lit("frag-"), "id").alias("node_id"), label.alias("label"), F.lit("frag").alias("kind"), "document_id")
    return docs.unionByName(frags)


#: Fragments of a document that are ordered in one task.
RUN = 4096


def edges(paragraphs: DataFrame, run: int = RUN) -> DataFrame:
    """(from_id, to_id, kind): document to fragment, and each fragment to the next of its document.

    A document is ordered in runs of ``run`` indices, so one that holds a great part of all rows is spread over tasks; the first
    fragment of a run finds the one before it among the ends of the runs, one row each.
    """
    hier = paragraphs.select(F.concat(F.lit("doc-"), "document_id").alias("from_id"), F.concat(F.lit("frag-"), "id").alias("to_id"), F.lit("hierarchy").alias("kind"))
    rows = paragraphs.select("id", "document_id", "paragraph_index", F.floor(F.col("paragraph_index") / run).alias("run"))
    rows = rows.withColumn("before", F.lag("id").over(Window.partitionBy("document_id", "run").orderBy("paragraph_index", "id")))
    ends = rows.groupBy("document_id", "run").agg(F.max(F.struct("paragraph_index", "id")).alias("end"))
    ends = ends.select("document_id", "run", F.lag("end.id").over(Window.partitionBy("document_id").orderBy("run")).alias("end_before"))
    inner = rows.filter("before IS NOT NULL").select("before", "id")
    first = rows.filter("before IS NULL").join(ends, ["document_id", "run"]).filter("end_before IS NOT NULL").select(F.col("end_before").alias("before"), "id")
    seq = inner.unionByName(first).select(F.concat(F.lit("frag-"), "before").alias("from_id"), F.concat(F.lit("frag-"), "id").alias("to_id"), F.lit("sequential").alias("kind"))
    return hier.unionByName(seq)


def _block_links(threshold: float, cross: bool, limit: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = key
        a = pdf[pdf["block"] == i]
        b = a if i == j else pdf[pdf["block"] == j]
        x, y = np.array(a["v"].tolist()), np.array(b["v"].tolist())
        if not len(x) or not len(y):
            return pd.DataFrame(columns=["source_id", "target_id", "similarity"])
        s = np.round(x @ y.T, 6)
        ia, ib = a["id"].to_numpy(), b["id"].to_numpy()
        keep = s >= threshold
        if i == j:
            keep &= ia[:, None] < ib[None, :]
        if cross:
            keep &= a["document_id"].to_numpy()[:, None] != b["document_id"].to_numpy()[None, :]
        r, c = np.nonzero(keep)
        out = pd.DataFrame({"source_id": np.minimum(ia[r], ib[c]), "target_id": np.maximum(ia[r], ib[c]), "similarity": s[r, c]})
        return out.sort_values(["similarity", "source_id", "target_id"], ascending=[False, True, True]).head(limit)

    return run


def relations(vectors: DataFrame, threshold: float = 0.75, limit: int | None = 400, cross_doc: bool = False, block_rows: int = 2048) -> DataFrame:
    """(source_id, target_id, similarity) of the most similar pairs of a chosen set (id, document_id, embedding).

    The set is cut into blocks by hash; a task takes a pair of blocks as one matrix product and keeps its own first ``limit``
    pairs, so no task or row number grows with the square of the set. The limit is a feature: between 1 and 2000.
    """
    n = max(1, min(400 if limit is None else int(limit), 2000))
    rows = vectors.select("id", "document_id", vc.unit(F.col("embedding")).alias("v")).filter("v IS NOT NULL")
    blocks = max(1, -(-rows.count() // block_rows))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    others = F.sequence(F.lit(0), F.lit(blocks - 1))
    spread = rows.withColumn("other", F.explode(others)).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    found = spread.groupBy("i", "j").applyInPandas(_block_links(threshold, cross_doc, n), "source_id string, target_id string, similarity double")
    return found.orderBy(F.desc("similarity"), "source_id", "target_id").limit(n)


def ego(vectors: DataFrame, center: str, threshold: float = 0.75, limit: int | None = 400) -> DataFrame:
    """(source_id, target_id, similarity): one record against all others."""
    n = max(1, min(400 if limit is None else int(limit), 2000))
    one = vectors.filter(F.col("id") == center).select(F.col("embedding").alias("c")).limit(1)
    near = vectors.filter(F.col("id") != center).join(F.broadcast(one))
    scored = near.select(F.lit(center).alias("source_id"), F.col("id").alias("target_id"), F.round(vc.cosine(F.col("embedding"), F.col("c")), 6).alias("similarity"))
    return scored.filter(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), "target_id").limit(n)


def neighbour_list(links: DataFrame) -> DataFrame:
    """(id, neighbour_id, similarity, strength): each relation seen from either end."""
    both = links.select(F.col("source_id").alias("id"), F.col("target_id").alias("neighbour_id"), "similarity").unionByName(links.select(F.col("target_id").alias("id"), F.col("source_id").alias("neighbour_id"), "similarity"))
    return both.withColumn("strength", F.when(F.col("similarity") > 0.82, "high").otherwise("normal"))


def ego_nodes(links: DataFrame, center: str) -> DataFrame:
    """(id, label): the centre and its neighbours once, labelled with the similarity in per cent."""
    around = neighbour_list(links).filter(F.col("id") == center).groupBy("neighbour_id").agg(F.max("similarity").alias("s"))
    near = around.select(F.col("neighbour_id").alias("id"), F.concat(F.round(F.col("s") * 100).cast("int").cast("string"), F.lit("%")).alias("label"))
    return links.sparkSession.range(1).select(F.lit(center).alias("id"), F.lit("100%").alias("label")).unionByName(near)


def relation_cap(percent: int) -> int:
    """Relations shown at a density of the slider."""
    return round(2000 * ((100 - percent) / 50))


def edge_style(similarity: Column) -> Column:
    """struct(width, length, ramp) of a semantic edge."""
    ramp = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (similarity - 0.7) / 0.3))
    return F.struct((1 + similarity * 4).alias("width"), (240 + 120 * (1 - similarity)).alias("length"), F.round(ramp, 6).alias("ramp"))


def heat(scores: DataFrame) -> DataFrame:
    """Adds ``normalized`` and ``relevant`` to scores (query_id, id, score); a zero range counts as 1."""
    ends = scores.groupBy("query_id").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    both = scores.join(F.broadcast(ends), "query_id")
    normal = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
    both = both.withColumn("normalized", F.round(normal, 6))
    return both.withColumn("relevant", (F.col("score") > 0.05) & (F.col("normalized") > 0.6)).drop("lo", "hi")


def visible_edges(all_edges: DataFrame, heated: DataFrame) -> DataFrame:
    """Adds ``visible``: a semantic edge needs both ends relevant, any other its target. One query's heat at a time."""
    hot = heated.filter(F.col("normalized") > 0.6).select(F.concat(F.lit("frag-"), "id").alias("node")).distinct()
    a = hot.select(F.col("node").alias("from_id"), F.lit(True).alias("from_hot"))
    b = hot.select(F.col("node").alias("to_id"), F.lit(True).alias("to_hot"))
    both = all_edges.join(a, "from_id", "left").join(b, "to_id", "left")
    seen = F.coalesce("to_hot", F.lit(False)) & ((F.col("kind") != "semantic") | F.coalesce("from_hot", F.lit(False)))
    return both.select(*all_edges.columns, seen.alias("visible"))


def hues(documents: DataFrame) -> DataFrame:
    """(id, hue): documents spread over the colour circle in order of age."""
    total = documents.agg(F.count("*").alias("total"))
    n = positions(documents.select("id", "created_at"), ["created_at", "id"]).join(F.broadcast(total))
    return n.select("id", F.round(F.col("position") * 360.0 / F.col("total") % 360, 4).alias("hue"))
