"""Near-duplicate records with small edits: similarity join over Hamming fingerprints with vantage points.

A record is the set of its distinct word n-grams. Its fingerprint has one bit of each of 192 minimum hashes, so the Hamming
distance of two fingerprints estimates their Jaccard distance, and it is a metric. The join has three levels:

1. Fingerprints of unrelated records all lie at about half of the bits from each other, where no vantage point prunes
   anything; so the space is first cut into buckets whose members agree in a group of minimum hashes (48 groups, each record in all).
2. A bucket above ``BUCKET`` members is cut into the shards of vantage points; a record stands in the shard of its nearest
   vantage point and, as a guest, in every shard that its radius may reach by the triangle bound.
3. Within a bucket or shard a vantage-point tree join gives the pairs within the radius: inner and outer half, and between the
   halves only the strip around the median distance.

An exact check of the n-gram sets follows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

BANDS, ROWS = 48, 4
HASHES = BANDS * ROWS
WORDS = HASHES // 64
#: Fingerprints of records at similarity 0.6 differ in 38.4 bits on average, with a deviation of 5.5.
RADIUS = 62
BUCKET, VANTAGES, LEAF = 4096, 16, 64
_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_rng = np.random.default_rng(20240)
_A = (_rng.integers(1, 1 << 31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_PACK = 16_384
_BLOCK = 2_000_000


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, n: int, seen: dict[str, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of lower-cased words."""
    words = _WORD.findall(text.lower()) if text else []
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    codes = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        c = seen.get(w)
        if c is None:
            c = seen[w] = xxhash.xxh3_64_intdigest(w)
        codes[i] = c
    h = codes[:m].copy()
    for j in range(1, n):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + m])
    return np.unique(h)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """(records, HASHES) minimum hashes of non-empty sets."""
    out = np.empty((len(sets), HASHES), np.uint32)
    begin = 0
    while begin < len(sets):
        end, total = begin, 0
        while end < len(sets) and (total == 0 or total + len(sets[end]) <= _PACK):
            total += len(sets[end])
            end += 1
        x = (np.concatenate(sets[begin:end]) >> np.uint64(32)).astype(np.uint32)
        at = np.concatenate(([0], np.cumsum([len(s) for s in sets[begin : end - 1]]))).astype(np.int64)
        for i in range(HASHES):
            out[begin:end, i] = np.minimum.reduceat(x * _A[i] + _B[i], at)
        begin = end
    return out


def _sign(n: int, least: int):
    """Key, id of the set, fingerprint and bucket keys of every record with enough n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for b in batches:
            if len(seen) > 300_000:
                seen.clear()
            kinds = b.column("kind").to_pylist()
            sets = [shingles(t, n, seen) for t in b.column("text").to_pylist()]
            use = [i for i, s in enumerate(sets) if len(s) >= least]
            if not use:
                continue
            sets = [sets[i] for i in use]
            salt = np.array([xxhash.xxh3_64_intdigest(str(kinds[i])) for i in use], np.uint64)
            sid = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64) ^ salt
            low = minima(sets)
            bits = np.packbits((low >> np.uint32(5)) & np.uint32(1), axis=1, bitorder="little").view(np.int64)
            keys = np.repeat(salt[:, None], BANDS, axis=1) + np.arange(BANDS, dtype=np.uint64)[None, :]
            for j in range(ROWS):
                keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + low[:, j::ROWS].astype(np.uint64))
            flat = pa.array(keys.view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(use) * BANDS + 1, BANDS, dtype=np.int32)), flat)
            at = pa.array(use)
            yield pa.RecordBatch.from_arrays(
                [b.column("kind").take(at), b.column("key").take(at), pa.array(sid.view(np.int64)), pa.array([len(s) for s in sets], pa.int32()), *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(WORDS)), lists],
                names=["kind", "key", "sid", "size", *(f"f{i}" for i in range(WORDS)), "bands"],
            )

    return run


# --- vantage-point tree join ------------------------------------------------------------------------------------------------


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int32)


def _strip(fps: np.ndarray, rows: np.ndarray, drows: np.ndarray, others: np.ndarray, dothers: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs between two halves: the triangle bound leaves only partners whose distances to the vantage point are close."""
    order = np.argsort(dothers, kind="stable")
    others, dothers = others[order], dothers[order]
    lo, hi = np.searchsorted(dothers, drows - radius, "left"), np.searchsorted(dothers, drows + radius, "right")
    yield from _expand(fps, rows, others, lo, hi, radius)


def _expand(fps: np.ndarray, rows: np.ndarray, others: np.ndarray, lo: np.ndarray, hi: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within the radius between rows[k] and others[lo[k]:hi[k]], in blocks of bounded size."""
    count = np.maximum(hi - lo, 0)
    use = np.flatnonzero(count)
    ends = np.cumsum(count[use])
    begin = 0
    while begin < len(use):
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + _BLOCK, "right")))
        some = use[begin:end]
        c = count[some]
        i = np.repeat(rows[some], c)
        j = others[np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(lo[some], c)]
        keep = _distance(fps[i], fps[j]) <= radius
        if keep.any():
            yield i[keep], j[keep]
        begin = end


def tree_pairs(fps: np.ndarray, rows: np.ndarray, radius: int, leaf: int = LEAF) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of ``rows`` whose fingerprints lie within the radius, by a vantage-point tree that is walked as it is built."""
    stack = [rows]
    while stack:
        part = stack.pop()
        n = len(part)
        if n < 2:
            continue
        if n <= leaf:
            yield from _expand(fps, part, part, np.arange(1, n + 1), np.full(n, n), radius)
            continue
        d = _distance(fps[part], fps[part[0]])
        middle = int(np.median(d))
        inside = d <= middle
        if inside.all():
            inside = d < middle
        if not inside.any():  # all at one distance from the vantage point: no tree parts them
            yield from _expand(fps, part, part, np.arange(1, n + 1), np.full(n, n), radius)
            continue
        a, b = part[inside], part[~inside]
        da, db = d[inside], d[~inside]
        near_a, near_b = da > middle - radius, db <= middle + radius
        yield from _strip(fps, a[near_a], da[near_a], b[near_b], db[near_b], radius)
        stack += [a, b]


def bucket_pairs(bucket: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within the radius inside each bucket; rows are sorted by bucket. Small buckets are leaves and go together."""
    _, start, size = np.unique(bucket, return_index=True, return_counts=True)
    end = np.repeat(start + size, size)
    rows = np.arange(len(bucket))
    leaf = np.repeat(size <= LEAF, size)
    yield from _expand(fps, rows[leaf], rows, rows[leaf] + 1, end[leaf], radius)
    for s, n in zip(start[size > LEAF], size[size > LEAF]):
        yield from tree_pairs(fps, np.arange(s, s + n), radius)


def _join_buckets(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(t: pa.Table) -> Iterator[pa.RecordBatch]:
            bucket, sid = t.column("bucket").to_numpy(), t.column("sid").to_numpy()
            home = t.column("home").to_numpy()
            fps = np.stack([t.column(f"f{i}").to_numpy() for i in range(WORDS)], axis=1).view(np.uint64)
            for i, j in bucket_pairs(bucket, fps, radius):
                use = (home[i] | home[j]) & (sid[i] != sid[j])
                a, b = sid[i[use]], sid[j[use]]
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= 100_000:
                t = pa.Table.from_batches(held)
                bucket = t.column("bucket").to_numpy()
                last = len(bucket) - int(np.searchsorted(bucket, bucket[-1], "left"))
                if last < len(bucket):
                    yield from flush(t.slice(0, len(bucket) - last))
                    held, rows = t.slice(len(bucket) - last).to_batches(), last
        if rows:
            yield from flush(pa.Table.from_batches(held))

    return run


def _overlap_shards(big: DataFrame, radius: int, vantages: int) -> DataFrame:
    """Cuts oversized buckets into the shards of their vantage points, guests within reach included."""
    pick = big.withColumn("v", F.row_number().over(Window.partitionBy("bucket").orderBy(F.xxhash64("sid")))).filter(F.col("v") <= vantages)
    pick = pick.select("bucket", "v", *[F.col(f"f{i}").alias(f"g{i}") for i in range(WORDS)])
    far = sum((F.bit_count(F.col(f"f{i}").bitwiseXOR(F.col(f"g{i}"))) for i in range(WORDS)), F.lit(0))
    at = big.join(pick, "bucket").withColumn("d", far)
    fields = ["bucket", "sid", *(f"f{i}" for i in range(WORDS))]
    near = at.groupBy(*fields).agg(F.min(F.struct("d", "v")).alias("nearest"), F.collect_list(F.struct("d", "v")).alias("all"))
    reach = F.filter("all", lambda x: x["d"] <= F.col("nearest.d") + 2 * radius)
    out = near.select(*fields, "nearest", F.explode(reach).alias("to"))
    return out.select(F.xxhash64("bucket", "to.v").alias("bucket"), "sid", *fields[2:], (F.col("to.v") == F.col("nearest.v")).alias("home"))


def _shingle_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for b in batches:
            if len(seen) > 300_000:
                seen.clear()
            sets = [shingles(t, n, seen) for t in b.column("text").to_pylist()]
            ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("sid"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["sid", "grams"])

    return run


def near_duplicates(df: DataFrame, key: str, text: str, kind: str, similarity: float = 0.8, n: int = 5, least: int = 1, radius: int = RADIUS, bucket: int = BUCKET, vantages: int = VANTAGES) -> tuple[DataFrame, DataFrame]:
    """(links, members) of records whose n-gram sets have at least the given Jaccard similarity.

    members: (kind, key, sid), the class of each record with at least ``least`` distinct n-grams; records of equal sets are one
    class, whatever their number. links: (a, b, similarity) between different classes, a < b. Null and empty texts have no
    n-grams and don't count; rows of one key count once.
    """
    rows = df.select(F.col(kind).alias("kind"), F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    fs = [f"f{i}" for i in range(WORDS)]
    ddl = "kind string, key string, sid long, size int, " + ", ".join(f"{f} long" for f in fs) + ", bands array<long>"
    signed = cut(rows.mapInArrow(_sign(n, least), ddl))
    members = signed.select("kind", "key", "sid").distinct()
    one = signed.select("sid", "bands").dropDuplicates(["sid"])
    spread = one.select("sid", F.explode("bands").alias("bucket"))
    shared = spread.withColumn("n", F.count("*").over(Window.partitionBy("bucket"))).filter("n > 1")
    placed = cut(shared.join(signed.select("sid", *fs).dropDuplicates(["sid"]), "sid").select("bucket", "sid", *fs, "n"))
    common = placed.filter(F.col("n") <= bucket).select("bucket", "sid", *fs, F.lit(True).alias("home"))
    large = _overlap_shards(placed.filter(F.col("n") > bucket).drop("n"), radius, vantages)
    shards = common.unionByName(large).repartition("bucket").sortWithinPartitions("bucket")
    near = cut(shards.mapInArrow(_join_buckets(radius), "a long, b long").distinct())
    wanted = near.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    first = signed.groupBy("sid").agg(F.min(F.struct("kind", "key")).alias("r")).join(wanted, "sid", "left_semi").select("sid", "r.kind", "r.key")
    texts = rows.join(first, ["kind", "key"]).dropDuplicates(["sid"]).select("sid", "text")
    sets = texts.mapInArrow(_shingle_sets(n), "sid long, grams array<long>")
    pairs = near.join(sets.select(F.col("sid").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("sid").alias("b"), F.col("grams").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    links = pairs.select("a", "b", (both / (F.size("x") + F.size("y") - both)).alias("similarity")).filter(F.col("similarity") >= similarity)
    return links, members


#: Classes of more equal copies than this are given by their representative only.
EXPAND = 64


def record_pairs(links: DataFrame, members: DataFrame, expand: int = EXPAND) -> DataFrame:
    """(kind, id_a, id_b): the pairs of records behind the links and within the classes of equal sets.

    A class of more than ``expand`` copies stands as a star: each copy is paired with the representative (its smallest key),
    and links of the class name the representative, so no quadratic number of rows comes out.
    """
    count = members.groupBy("kind", "sid").agg(F.count("*").alias("copies"), F.min("key").alias("head"))
    sized = members.join(count, ["kind", "sid"])
    shown = sized.filter((F.col("copies") <= expand) | (F.col("key") == F.col("head")))
    x = shown.select("kind", F.col("sid").alias("a"), F.col("key").alias("ka"))
    y = shown.select("kind", F.col("sid").alias("b"), F.col("key").alias("kb"))
    across = links.select("a", "b").join(x, "a").join(y, ["b", "kind"]).select("kind", "ka", "kb")
    few = shown.filter((F.col("copies") > 1) & (F.col("copies") <= expand))
    inside = few.select("kind", "sid", F.col("key").alias("ka")).join(few.select("kind", "sid", F.col("key").alias("kb")), ["kind", "sid"]).filter("ka < kb").select("kind", "ka", "kb")
    star = sized.filter((F.col("copies") > expand) & (F.col("key") != F.col("head"))).select("kind", F.col("head").alias("ka"), F.col("key").alias("kb"))
    out = across.unionByName(inside).unionByName(star)
    return out.select("kind", F.least("ka", "kb").alias("id_a"), F.greatest("ka", "kb").alias("id_b")).distinct()


def groups(links: DataFrame, members: DataFrame, most: int = 64) -> DataFrame:
    """(kind, key, group_id, n_links) of every member: its group and the number of other classes that its class is linked to.

    Groups are the connected components of the links. Labels sink along the links and then jump to the label of their label, so a
    chain of n classes needs about log n rounds; a round is written before the next, and ``most`` only guards against a loop.
    Without a link, a class is a group of its own. ``group_id`` is the smallest key of the group.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("low")))
    for _ in range(most):
        near = both.join(label.select(F.col("a").alias("b"), "low"), "b").groupBy("a").agg(F.min("low").alias("near"))
        sunk = label.join(near, "a").select("a", F.col("low").alias("was"), F.least("low", "near").alias("low"))
        jump = label.select(F.col("a").alias("low"), F.col("low").alias("lower"))
        step = cut(sunk.join(jump, "low", "left").select("a", "was", F.least("low", F.coalesce("lower", "low")).alias("low")))
        moved = step.filter("was != low").limit(1).count()
        label = step.select("a", "low")
        if not moved:
            break
    degree = both.groupBy(F.col("a").alias("sid")).agg(F.count("*").alias("n_links"))
    tied = members.join(label.select(F.col("a").alias("sid"), "low"), "sid", "left").join(degree, "sid", "left")
    tied = tied.withColumn("low", F.coalesce("low", "sid"))
    heads = tied.groupBy("kind", "low").agg(F.min("key").alias("group_id"))
    return tied.join(heads, ["kind", "low"]).select("kind", "key", "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
