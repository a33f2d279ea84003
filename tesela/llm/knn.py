"""Most similar vectors: multi-index hashing over learned rotated binary codes, reranked by exact cosines.

Codes have ``BITS`` bits, cut into substrings of 16. Two codes whose substring differs in at most one bit agree in one of its
two halves, so each substring is indexed under either half (a shard), and the pigeonhole probing of the other half happens
inside the shard. What lies within the Hamming radius is reranked with the float vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

BITS, SUBSTRING = 128, 16
#: Hamming radius: codes of 128 bits differ in 18.4 bits on average at cosine 0.9, with a deviation of 4; at 0.95 in 13.
RADIUS = 28
#: Rows on which the rotations are learned, at most; every row is coded and indexed.
SAMPLE = 4096
_BLOCK = 4_000_000


def learn_rotations(x: np.ndarray, bits: int = BITS, rounds: int = 20, seed: int = 7) -> np.ndarray:
    """(dim, bits) projection made of rotations, each turned until the signs fit the sample (iterative quantization)."""
    dim = x.shape[1]
    rng = np.random.default_rng(seed)
    parts = []
    for _ in range(-(-bits // dim)):
        r, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
        for _ in range(rounds if len(x) else 0):
            u, _, vt = np.linalg.svd(x.T @ np.where(x @ r >= 0, 1.0, -1.0))
            r = u @ vt
        parts.append(r)
    return np.hstack(parts)[:, :bits].astype(np.float32)


def _matrix(col: pa.ChunkedArray | pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of usable vectors (right length, finite, not all zero) and their matrix."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    lengths = np.asarray(pc.fill_null(pc.list_value_length(col), -1).to_numpy(zero_copy_only=False))
    ok = np.flatnonzero(lengths == dim)
    flat = col.take(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    use = np.isfinite(flat).all(axis=1) & (np.abs(flat).max(axis=1, initial=0) > 0)
    return ok[use], flat[use]


def _encode(rotation: np.ndarray, dim: int, out: pa.Schema):
    words = rotation.shape[1] // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = _matrix(b.column("v"), dim)
            if not len(rows):
                continue
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            bits = (unit.astype(np.float32) @ rotation) >= 0
            packed = np.packbits(bits, axis=1, bitorder="little")
            code = np.ascontiguousarray(packed).view(np.int64)
            kinds = b.column("kind").take(pa.array(rows))
            raw = np.ascontiguousarray(x.astype(np.float32))
            vid = np.array([xxhash.xxh3_64_intdigest(r.tobytes() + str(k).encode()) for r, k in zip(raw, kinds.to_pylist())], np.uint64).view(np.int64)
            arrays = [kinds, b.column("key").take(pa.array(rows)), pa.array(vid), *(pa.array(code[:, i]) for i in range(words)), b.column("v").take(pa.array(rows))]
            yield pa.RecordBatch.from_arrays(arrays, schema=out)

    return run


def _shards(words: int):
    """(place, vid, codes): each substring under the value of either half (the shard), with the other half behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            codes = np.stack([b.column(f"c{i}").to_numpy(zero_copy_only=False) for i in range(words)], axis=1)
            octets = np.ascontiguousarray(codes).view(np.uint8).reshape(n, -1).astype(np.int32)
            number = octets.shape[1]
            group = b.column("kn").to_numpy(zero_copy_only=False).astype(np.int32)
            shard = (group << 12)[:, None] | (np.arange(number, dtype=np.int32) << 8)[None, :] | octets
            rest = octets[:, np.arange(number) ^ 1]  # the other half of the same substring
            order = np.repeat(np.arange(n), number)
            at = pa.array(order)
            yield pa.RecordBatch.from_arrays(
                [pa.array((shard << 8 | rest).ravel()), b.column("vid").take(at), *(b.column(f"c{i}").take(at) for i in range(words))],
                names=["place", "vid", *(f"c{i}" for i in range(words))],
            )

    return run


def near_codes(place: np.ndarray, codes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of rows, sorted by ``place``, that share a shard, differ there in at most one bit of the rest,
    and lie within the radius; in blocks of bounded size."""
    for mask in [0, *(1 << k for k in range(8))]:
        target = place ^ mask
        if mask:
            use = np.flatnonzero(target > place)
            lo, hi = np.searchsorted(place, target[use], "left"), np.searchsorted(place, target[use], "right")
        else:
            use = np.arange(len(place))
            lo, hi = use + 1, np.searchsorted(place, place, "right")
        count = np.maximum(hi - lo, 0)
        use, lo, count = use[count > 0], lo[count > 0], count[count > 0]
        ends = np.cumsum(count)
        begin = 0
        while begin < len(use):
            base = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, base + _BLOCK, "right")))
            c = count[begin:end]
            i = np.repeat(use[begin:end], c)
            j = np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(lo[begin:end], c)
            d = np.zeros(len(i), np.int32)
            for w in range(codes.shape[1]):
                d += np.bitwise_count(codes[i, w] ^ codes[j, w])
            keep = d <= radius
            if keep.any():
                yield i[keep], j[keep]
            begin = end


def _probe(words: int, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sorted by place: whole shards are gathered until a block is full
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
            place = table.column("place").to_numpy().astype(np.int64)
            vid = table.column("vid").to_numpy()
            codes = np.stack([table.column(f"c{i}").to_numpy() for i in range(words)], axis=1).view(np.uint64)
            for i, j in near_codes(place, codes, radius):
                a, b = np.minimum(vid[i], vid[j]), np.maximum(vid[i], vid[j])
                pairs = np.unique(np.stack([a, b], axis=1)[a != b], axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= 200_000:
                t = pa.Table.from_batches(held)
                shard = t.column("place").to_numpy() >> 8
                last = np.searchsorted(shard[::-1] != shard[-1], True)  # rows of the open shard stay
                if last < len(shard):
                    yield from flush(t.slice(0, len(shard) - last))
                    held = t.slice(len(shard) - last).to_batches()
                    rows = last
        if rows:
            yield from flush(pa.Table.from_batches(held))

    return run


def _type_of(name: str) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[name]


def similar(df: DataFrame, key: str, vec: str, kind: str, k: int = 5, min_cosine: float = 0.9, bits: int = BITS, radius: int = RADIUS, sample: int = SAMPLE) -> DataFrame:
    """(kind, id_a, id_b, cosine): pairs of at least ``min_cosine`` of which one is among the k most similar of the other.

    ``kind`` separates collections that share a plan. Null and all-zero vectors, such with other lengths than the rest and
    such with values that are no numbers are left out; rows of one key count once. Equal vectors are indexed once and their
    copies put back at the end, the k nearest by key among ties, so a large group of copies makes k pairs a row, no more.
    Recall is that of the probing: two codes are missed where each of the 8 substrings differs in 2 bits or more.
    """
    rows = df.select(F.col(kind).alias("kind"), F.col(key).alias("key"), F.col(vec).alias("v")).filter("v IS NOT NULL")
    n = rows.count()
    part = rows.select("v")
    some = (part.sample(False, min(1.0, 2 * sample / n), 11) if n > sample else part).limit(sample).toArrow()
    dims = np.bincount([len(x) for x in some.column("v").to_pylist()]) if some.num_rows else np.array([0, 1])
    dim = int(np.argmax(dims))
    _, x = _matrix(some.column("v"), dim)
    rotation = learn_rotations(x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else np.zeros((0, dim)), bits)
    words = bits // 64
    key_type = dict(rows.dtypes)["key"]
    schema = pa.schema([("kind", pa.string()), ("key", _type_of(key_type)), ("vid", pa.int64()), *((f"c{i}", pa.int64()) for i in range(words)), ("v", pa.list_(pa.float32()))])
    ddl = f"kind string, key {key_type}, vid long, " + "".join(f"c{i} long, " for i in range(words)) + "v array<float>"
    coded = cut(rows.select("kind", "key", F.col("v").cast("array<float>").alias("v")).mapInArrow(_encode(rotation, dim, schema), ddl))
    codes = [f"c{i}" for i in range(words)]
    # collections meet in no shard, but for those of an equal number; their pairs go at the join
    one = coded.select("vid", (F.crc32("kind") % 2048).cast("int").alias("kn"), *codes).dropDuplicates(["vid"])
    spread = one.mapInArrow(_shards(words), "place int, vid long, " + ", ".join(f"{c} long" for c in codes))
    sharded = spread.repartition(F.shiftright("place", 8)).sortWithinPartitions("place")
    near = cut(sharded.mapInArrow(_probe(words, radius), "a long, b long").distinct())
    # vectors move once, and only those with a candidate go on
    asked = near.select(F.explode(F.array("a", "b")).alias("vid")).distinct()
    vectors = cut(coded.select("vid", "kind", "v").join(asked, "vid", "left_semi").dropDuplicates(["vid"]))

    def dot(x: str, y: str):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)

    va = vectors.select(F.col("vid").alias("a"), F.col("kind").alias("ka"), F.col("v").alias("va"))
    vb = vectors.select(F.col("vid").alias("b"), F.col("kind").alias("kb"), F.col("v").alias("vb"))
    pairs = near.join(va, "a").join(vb, "b").filter("ka = kb")
    cosine = dot("va", "vb") / F.sqrt(dot("va", "va") * dot("vb", "vb"))
    links = cut(pairs.select("a", "b", cosine.alias("cosine")).filter(F.col("cosine") >= min_cosine))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
    members = coded.select("vid", "kind", "key").repartition("vid").dropDuplicates(["vid", "key"])
    # of a group of copies, only its first k + 1 members can be among the nearest of a record
    heads = members.withColumn("n", F.row_number().over(Window.partitionBy("vid").orderBy("key"))).filter(F.col("n") <= k + 1)
    twins = heads.filter("n = 2").select(F.col("vid").alias("a"), F.col("vid").alias("b"), F.lit(1.0).alias("cosine"))
    near_heads = both.unionByName(twins).join(heads.select(F.col("vid").alias("b"), F.col("key").alias("other")), "b")
    order = Window.partitionBy("a").orderBy(F.desc("cosine"), "other")
    best = near_heads.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).select(F.col("a").alias("vid"), "other", "cosine")
    mine = members.join(best, "vid").filter(F.col("key") != F.col("other"))
    top = mine.withColumn("n", F.row_number().over(Window.partitionBy("kind", "key").orderBy(F.desc("cosine"), "other"))).filter(F.col("n") <= k)
    return top.select("kind", F.least("key", "other").alias("id_a"), F.greatest("key", "other").alias("id_b"), "cosine").dropDuplicates(["kind", "id_a", "id_b"])


#: Queries of one block of the exact scan.
SCAN_BLOCK, SCAN_ROWS = 4096, 1024


def _scan(keys: list, kinds: list[str], unit: np.ndarray, k: int, dim: int):
    """First k rows of a task for each query of a block, by exact cosines; ties by key."""

    def nearest(cos: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of a matrix that can still be among the first k + 1 (the query itself may be one) of their query."""
        n = min(k + 1, cos.shape[1])
        least = -np.partition(-cos, n - 1, axis=1)[:, n - 1]
        return np.nonzero(cos >= np.maximum(np.maximum(least, known), -1.5)[:, None])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner = np.array(kinds, dtype=object)
        known = np.full(len(keys), -1.5)
        held: list[pd.DataFrame] = []
        rows_held, key_type = 0, None

        def first() -> pd.DataFrame:
            every = pd.concat(held).drop_duplicates(["i", "key"]).sort_values(["i", "cos", "key"], ascending=[True, False, True])
            return every.groupby("i", sort=False).head(k + 1)

        for b in batches:
            rows, x = _matrix(b.column("v"), dim)
            others, key_type = b.column("key").take(pa.array(rows)).to_pandas().to_numpy(), b.column("key").type
            mine = np.array(b.column("kind").take(pa.array(rows)).to_pylist(), dtype=object)
            for at in range(0, len(rows), SCAN_ROWS):  # a matrix of bounded size at a time
                names = pd.MultiIndex.from_arrays([mine[at : at + SCAN_ROWS], others[at : at + SCAN_ROWS]])
                use = at + np.flatnonzero(~names.duplicated())  # a row that is delivered twice takes one place
                cos = np.round(unit @ (x[use] / np.linalg.norm(x[use], axis=1, keepdims=True)).T, 6)
                cos[owner[:, None] != mine[None, use]] = -2.0
                i, j = nearest(cos, known)
                held.append(pd.DataFrame({"i": i, "cos": cos[i, j], "key": others[use[j]]}))
                rows_held += len(i)
                if rows_held > 4 * (k + 1) * len(keys) + 10_000:
                    held = [first()]
                    rows_held = len(held[0])
                    full = held[0].groupby("i")["cos"].agg(["size", "min"])
                    full = full[full["size"] > k]
                    known[full.index.to_numpy()] = full["min"].to_numpy()
        if rows_held:
            out = first()
            i = out["i"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(owner[i], pa.string()), pa.array([keys[a] for a in i], key_type), pa.array(out["key"].tolist(), key_type), pa.array(out["cos"].to_numpy())], names=["kind", "query", "key", "cosine"])

    return run


def scan_top_k(df: DataFrame, queries: DataFrame, key: str, vec: str, kind: str, k: int = 5, block: int = SCAN_BLOCK) -> DataFrame:
    """(kind, query, key, cosine, rank): the k most similar rows of a stated set of queries, by exact cosines over all rows.

    Queries go in blocks of ``block``, which the driver sends to the tasks one after another; each task gives the first k of
    its rows for each query. The rules for vectors and copies are those of ``similar``; a query is no neighbour of itself.
    """
    cols = [F.col(kind).alias("kind"), F.col(key).alias("key"), F.col(vec).cast("array<float>").alias("v")]
    rows = df.select(*cols).filter("v IS NOT NULL")
    asked = queries.select(*cols).filter("v IS NOT NULL").dropDuplicates(["kind", "key"])
    blocks = max(1, -(-asked.count() // block))
    key_type = dict(rows.dtypes)["key"]
    ddl = f"kind string, query {key_type}, key {key_type}, cosine double"
    parts = rows.sparkSession.createDataFrame([], ddl)
    for n in range(blocks):
        some = asked.filter(F.pmod(F.xxhash64("kind", "key"), F.lit(blocks)) == n).toArrow()
        if not some.num_rows:
            continue
        dim = int(np.argmax(np.bincount([len(x) for x in some.column("v").to_pylist()])))
        at, x = _matrix(some.column("v"), dim)
        keys, kinds = [some.column("key")[i].as_py() for i in at], [some.column("kind")[i].as_py() for i in at]
        parts = parts.unionByName(rows.mapInArrow(_scan(keys, kinds, x / np.linalg.norm(x, axis=1, keepdims=True), k, dim), ddl))
    found = parts.filter("query != key").dropDuplicates(["kind", "query", "key"])
    order = Window.partitionBy("kind", "query").orderBy(F.desc("cosine"), "key")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
