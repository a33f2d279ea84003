"""Inventory, integrity checks and maintenance of the document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def unique(df: DataFrame, key: str = "id") -> DataFrame:
    """One row a key; rows that were delivered twice are equal."""
    return df.dropDuplicates([key])


def counts(documents: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(id, title, mime_type, created_at, n_paragraphs), 0 for documents without any.

    The paragraphs are counted before the join, so one row a document is shuffled and no document is a hot key.
    """
    n = paragraphs.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("n"))
    docs = documents.select("id", "title", "mime_type", "created_at")
    return docs.join(n, "id", "left").select("id", "title", "mime_type", "created_at", F.coalesce("n", F.lit(0)).alias("n_paragraphs"))


def newest_with_counts(documents: DataFrame, paragraphs: DataFrame, limit: int = 10) -> DataFrame:
    newest = documents.select("id", "title", "mime_type", "created_at").orderBy(F.desc("created_at"), F.asc("id")).limit(limit)
    return counts(newest, paragraphs.join(F.broadcast(newest.select(F.col("id").alias("document_id"))), "document_id", "left_semi"))


def listing(paragraphs: DataFrame, document_id: str) -> DataFrame:
    """Fragments of one document in order, with their lengths."""
    rows = paragraphs.filter(F.col("document_id") == document_id)
    return rows.select("id", "paragraph_index", "parent_chunk_id", F.col("metadata.context_path").alias("context_path"), F.length("raw_content").alias("n_chars")).orderBy("paragraph_index", "id")


def orphans(paragraphs: DataFrame, documents: DataFrame) -> DataFrame:
    return paragraphs.select("id", "document_id", "paragraph_index").join(documents.select(F.col("id").alias("document_id")), "document_id", "left_anti")


def empty_documents(documents: DataFrame, paragraphs: DataFrame) -> DataFrame:
    return documents.select("id", "title", "r2_key").join(paragraphs.select(F.col("document_id").alias("id")).distinct(), "id", "left_anti")


def totals(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with the number of rows of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias(name))
        out = one if out is None else out.join(F.broadcast(one))
    return out


def null_distribution(df: DataFrame, column: str) -> DataFrame:
    """(status, n): rows with and without a value, in two groups."""
    status = F.when(F.col(column).isNull(), "null").otherwise("value")
    return df.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def delete_documents(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The tables without the documents ``ids`` (id) and all that hangs on them; parents that vanish become null."""
    gone = ids.select(F.col("id").alias("document_id")).distinct()
    out = dict(tables)
    out["rag_documents"] = tables["rag_documents"].join(gone.withColumnRenamed("document_id", "id"), "id", "left_anti")
    for name in ("document_paragraphs", "document_parent_chunks", "document_entities"):
        if name in tables:
            out[name] = tables[name].join(gone, "document_id", "left_anti")
    if "document_parent_chunks" in tables and "document_paragraphs" in tables:
        kept = out["document_parent_chunks"].select(F.col("id").alias("parent_chunk_id"), F.lit(True).alias("there"))
        joined = out["document_paragraphs"].join(kept, "parent_chunk_id", "left")
        out["document_paragraphs"] = joined.withColumn("parent_chunk_id", F.when(F.col("there"), F.col("parent_chunk_id"))).drop("there").select(tables["document_paragraphs"].columns)
    if "entity_relations" in tables and "document_entities" in tables:
        live = out["document_entities"].select("id")
        for end in ("source_entity_id", "target_entity_id"):
            lost = tables["document_entities"].select("id").join(live, "id", "left_anti").select(F.col("id").alias(end))
            out["entity_relations"] = out["entity_relations"].join(lost, end, "left_anti")
    return out


def entity_key(column: str):
    return F.lower(F.trim(column))


def unique_entities(entities: DataFrame) -> DataFrame:
    """First entity (by id) of each name in a document, names compared without case and outer blanks; blank names go."""
    named = entities.withColumn("key", entity_key("entity_name")).filter("key IS NOT NULL AND key != ''")
    w = Window.partitionBy("document_id", "key").orderBy("id")
    return named.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def resolve_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(document_id, source_id, target_id, relation_type): ends given by name, found among the document's unique entities.

    relations (document_id, source, target, relation_type); those with an unknown end go.
    """
    known = unique_entities(entities).select("document_id", "key", "id")
    s = known.select("document_id", F.col("key").alias("s"), F.col("id").alias("source_id"))
    t = known.select("document_id", F.col("key").alias("t"), F.col("id").alias("target_id"))
    keyed = relations.withColumn("s", entity_key("source")).withColumn("t", entity_key("target"))
    return keyed.join(s, ["document_id", "s"]).join(t, ["document_id", "t"]).select("document_id", "source_id", "target_id", F.lower(F.trim("relation_type")).alias("relation_type"))


def merged_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(source_id, target_id, relation_type, n): stored relations moved to the first entity of each name; unknown ends go."""
    keyed = entities.withColumn("key", entity_key("entity_name")).filter("key IS NOT NULL AND key != ''")
    first = keyed.withColumn("first_id", F.min("id").over(Window.partitionBy("document_id", "key"))).select("id", "first_id")
    s = first.select(F.col("id").alias("source_entity_id"), F.col("first_id").alias("source_id"))
    t = first.select(F.col("id").alias("target_entity_id"), F.col("first_id").alias("target_id"))
    joined = relations.join(s, "source_entity_id").join(t, "target_entity_id")
    return joined.groupBy("source_id", "target_id", F.lower(F.trim("relation_type")).alias("relation_type")).agg(F.count("*").alias("n"))
