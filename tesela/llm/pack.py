"""Filling containers of fixed capacity: sum-of-squares packing, sharded, with a second round for poorly filled bins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

CAPACITY = 4096


def byte_tokens(text: Column) -> Column:
    """Tokens of the public byte-level tokenizer of ByT5: one for each UTF-8 byte and an end mark. null: null."""
    return F.octet_length(text) + F.lit(1)


class SumOfSquares:
    """Online packing: each item goes where the sum of the squared numbers of open bins per residual gap becomes smallest.

    State is one count per gap and a stack of the open bins of each gap; a bin whose gap is 0 is closed.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bins = 0

    def place(self, size: int) -> tuple[int, int]:
        """The bin of an item of 1..capacity, and the gap that stays in it."""
        c, n = self.capacity, self.count
        # a bin of gap g leaves g and enters g - size: change 2*(n[g-size] - n[g]) + 2; the gap 0 isn't counted
        gaps = n[size:]
        cost = np.where(gaps > 0, 2 * (n[: c + 1 - size] - gaps) + 2, np.iinfo(np.int64).max)
        if gaps[0]:
            cost[0] = 1 - 2 * gaps[0]  # closes the bin
        k = int(np.argmin(cost))
        fresh = 2 * n[c - size] + 1 if size < c else 0
        if cost[k] <= fresh:
            gap = k + size
            bin_ = self.open[gap].pop()
            n[gap] -= 1
        else:
            gap, bin_ = c, self.bins
            self.bins += 1
        left = gap - size
        if left:
            self.open[left].append(bin_)
            n[left] += 1
        return bin_, left


def _pack_shards(capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows of a shard follow each other (sorted by shard); one packer lives at a time
        packer, shard = None, None
        for pdf in batches:
            bins = np.empty(len(pdf), np.int64)
            shards, sizes = pdf["shard"].to_numpy(), pdf["n_tokens"].to_numpy()
            for i in range(len(pdf)):
                if shards[i] != shard:
                    packer, shard = SumOfSquares(capacity), shards[i]
                bins[i] = packer.place(int(sizes[i]))[0]
            yield pdf.assign(bin=bins)

    return run


def pieces_of(df: DataFrame, id_col: str, tokens: Column, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start_token, n_tokens): one row per item; an item above the capacity gives full pieces and a rest."""
    sized = df.select(F.col(id_col), F.coalesce(tokens, F.lit(0)).cast("long").alias("__n"))
    last = F.greatest(F.ceil(F.col("__n") / capacity) - 1, F.lit(0))
    return (
        sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
        .withColumn("start_token", F.col("piece") * capacity)
        .withColumn("n_tokens", F.least(F.lit(capacity), F.col("__n") - F.col("start_token")))
        .drop("__n")
    )


def pack(df: DataFrame, id_col: str, tokens: Column, capacity: int = CAPACITY, shard_tokens: int = 32 << 20, rounds: int = 1) -> DataFrame:
    """Assigns every item of ``df`` to containers of ``capacity`` tokens.

    Result: (id, piece, start_token, n_tokens, bin_id string). Items are spread by hash over shards of about
    ``shard_tokens`` tokens, each packed by itself; then the bins that stay under 97 % full are packed once more as items,
    over fewer shards. An item above the capacity is cut into full pieces and a rest, no other item is.
    Items of 0 tokens (null texts) stand in the bin 'empty'. Equal ids are packed as separate items.
    """
    items = pieces_of(df, id_col, tokens, capacity)
    total = items.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    full = items.filter(F.col("n_tokens") == capacity).withColumn("bin0", F.concat(F.lit("full-"), F.col(id_col).cast("string"), F.lit("-"), F.col("piece").cast("string")))
    empty = items.filter("n_tokens <= 0").withColumn("bin0", F.lit("empty"))
    rest = items.filter((F.col("n_tokens") > 0) & (F.col("n_tokens") < capacity))
    rest = rest.withColumn("shard", F.pmod(F.xxhash64(F.col(id_col), "piece"), F.lit(shards)))
    kind = dict(df.dtypes)[id_col]
    packed = (
        rest.repartition(int(max(1, min(shards, 4096))), "shard")
        .sortWithinPartitions("shard", F.xxhash64("piece", F.col(id_col)))
        .select("shard", "n_tokens", F.col(id_col).alias("__id"), "piece", "start_token")
        .mapInPandas(_pack_shards(capacity), f"shard long, n_tokens long, __id {kind}, piece long, start_token long, bin long")
        .withColumn("bin0", F.concat_ws("-", F.col("shard").cast("string"), F.col("bin").cast("string")))
        .withColumnRenamed("__id", id_col)
    )
    if rounds and shards > 1:
        packed = cut(packed)  # read twice, and both must see the same bins
    cols = [id_col, "piece", "start_token", "n_tokens", "bin0"]
    fills = packed.groupBy("bin0").agg(F.sum("n_tokens").alias("fill"))
    if rounds and shards > 1:
        loose = fills.filter(F.col("fill") < int(capacity * 0.97))
        again = max(1, shards // 64)
        second = (
            loose.withColumn("shard", F.pmod(F.xxhash64("bin0"), F.lit(again)))
            .withColumnRenamed("fill", "n_tokens")
            .repartition(int(again), "shard")
            .sortWithinPartitions("shard", F.desc("n_tokens"), "bin0")
            .select("shard", "n_tokens", "bin0")
            .mapInPandas(_pack_shards(capacity), "shard long, n_tokens long, bin0 string, bin long")
            .select("bin0", F.concat(F.lit("again-"), F.col("shard").cast("string"), F.lit("-"), F.col("bin").cast("string")).alias("bin1"))
        )
        packed = packed.join(second, "bin0", "left").withColumn("bin0", F.coalesce("bin1", "bin0"))
    out = packed.select(cols).unionByName(full.select(cols)).unionByName(empty.select(cols))
    return out.withColumnRenamed("bin0", "bin_id")


def bin_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, share of the room that is filled."""
    bins = packed.filter("bin_id != 'empty'").groupBy("bin_id").agg(F.sum("n_tokens").alias("fill"))
    return bins.agg(F.count("*").alias("containers"), F.sum("fill").alias("tokens"), (F.sum("fill") / (F.count("*") * capacity)).alias("filled"))
