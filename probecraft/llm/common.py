"""Helpers shared by the training-data operators."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

M64 = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Odd multipliers for five consecutive words (any odd constants do).
MULTIPLIERS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="probecraft-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def settled(df: DataFrame, scratch: Scratch) -> DataFrame:
    """df, if it only filters and selects from files, so that a task that runs again sees the same rows in the same order; else written."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.children().size() == 1 and plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().apply(0)
    return df if plan.children().size() == 0 and file_bytes(df) else scratch.write(df)


class Scratch:
    """Written tables in the shared folder, which cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/probecraft/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later plan reads."""
        path, _ = self.paths.pop(id(df))
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def keep(self, *read: DataFrame) -> None:
        """Delete all tables but those that one of these plans reads."""
        folders = {f.rsplit("/", 2)[-2] for df in read for f in df.inputFiles()}
        for path, df in list(self.paths.values()):
            if path.rsplit("/", 1)[-1] not in folders:
                self.drop(df)


def partitions(spark: SparkSession, source: DataFrame | None = None, mb: int = 12) -> int:
    """Tasks of a shuffle: the session's number, or more if the files that source reads exceed mb MB for each."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-file_bytes(source) // (mb << 20)) if source is not None else 1)


def file_bytes(df: DataFrame) -> int:
    """Size of the files that df reads, as the catalog knows it; rows that are in no file count nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    found = [leaves.apply(i) for i in range(leaves.size())]
    return sum(int(str(x.stats().sizeInBytes())) for x in found if "Relation" in x.nodeName() and x.nodeName() != "LocalRelation")


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs outside space and \\x09-\\x0D, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: White space of words: the bytes 0x20 and 0x09 to 0x0D.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: A number for each byte, and an odd base whose powers place it.
LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0xC2B2AE3D27D4EB4F
#: Bytes of text hashed together.
PORTION = 1 << 19


@functools.lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse modulo 2^64, to the powers 0 to n - 1."""
    both = (np.full(n, x, np.uint64) for x in (BASE, pow(BASE, -1, 1 << 64)))
    out = []
    for x in both:
        x[0] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return tuple(out)


def hashed_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the words of data: runs of other bytes than white space."""
    raw = np.frombuffer(data, np.uint8)
    edge = np.diff(np.concatenate([[True], BLANK[raw], [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
    if not len(start):
        return start, np.empty(0, np.uint64)
    up, down = powers(max(PORTION, 1 << len(data).bit_length()))
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum(LETTER[raw] * up[: len(raw)], out=total[1:])
    return start, mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def word_sequences(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, the one after the last, owner of each word counted from the first, hash of each word) for portions of texts, in order."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) < PORTION):
            size += len(texts[hi]) + 1
            hi += 1
        if hi == lo + 1 and size > PORTION:  # a very long text, a piece of whole words at a time
            text, at, got = texts[lo], 0, []
            while at < len(text):
                cut = at + PORTION
                while cut < len(text) and not BLANK[text[cut]]:
                    cut += 1
                got.append(hashed_words(text[at:cut])[1])
                at = cut
            h = np.concatenate(got)
            yield lo, hi, np.zeros(len(h), np.int64), h
        else:
            start, h = hashed_words(b"\n".join(texts[lo:hi]))
            first = np.cumsum([0, *(len(t) + 1 for t in texts[lo : hi - 1])])
            yield lo, hi, np.searchsorted(first, start, "right") - 1, h
        lo = hi


class WordHashes(dict):
    """Word to 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def windows(h: np.ndarray, size: int = 5) -> np.ndarray:
    """A 64-bit hash of each run of size consecutive word hashes."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for i in range(size):
        acc += mix(h[i : i + n] + np.uint64(i + 1)) * MULTIPLIERS[i % 5]
    return mix(acc)


def batches(rows: dict[str, tuple[pa.DataType, list | np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for t, v in rows.values()], names=list(rows))


def spread_join(rows: DataFrame, named: DataFrame, key: str, held: str, how: str = "inner", most: int = 100_000) -> DataFrame:
    """Join of rows with named, which has one row for each key, or some; its column held counts the key's rows.

    Keys with more than one in ``most`` of the rows, which are at most that many, are broadcast; the others are joined by a shuffle.
    """
    floor = named.agg(F.coalesce(F.sum(held), F.lit(0))).first()[0] // most
    hot = F.broadcast(named.filter(F.col(held) > max(floor, 100)))
    cold = named.filter(F.col(held) <= max(floor, 100))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key, how))


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(id, label) for every id in the edges (a, b): label is the smallest id reachable.

    Smallest-neighbour labels with pointer jumping: each round is joins and aggregations on the
    edge table alone, written to the shared folder, until no label changes.
    """
    both = scratch.write(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a"))).filter("u <> v").distinct())
    labels = scratch.write(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.col("u")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "v"), "v").groupBy(F.col("u").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("lower"))
        up = labels.select(F.col("id").alias("lower"), F.col("label").alias("jump"))
        new = scratch.write(step.join(up, "lower", "left").select("id", F.least("lower", F.coalesce("jump", "lower")).alias("label"), (F.least("lower", F.coalesce("jump", "lower")) < F.col("label")).alias("moved")))
        moved = not new.filter("moved").isEmpty()
        scratch.drop(labels)
        labels = new
        if not moved:
            scratch.drop(both)
            return labels.select("id", "label")


def dumps(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed binary."""
    import pickle

    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps([np.ascontiguousarray(a) for a in arrays], protocol=5))


def loads(data: bytes) -> list[np.ndarray]:
    import pickle

    import zstandard

    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


class Dealer:
    """Collects rows of parallel arrays and deals them out to buckets as packed binaries."""

    def __init__(self, buckets: int, limit: int = 4_000_000):
        self.buckets, self.limit, self.held, self.size = buckets, limit, [], 0

    def add(self, *arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
        """arrays: a key (unsigned 64-bit, whose remainder is the bucket), then columns."""
        if len(arrays[0]):
            self.held.append(arrays)
            self.size += len(arrays[0])
        if self.size >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        columns = [np.concatenate(c) for c in zip(*self.held, strict=True)]
        self.held, self.size = [], 0
        yield from self.packed(columns[0], columns)

    def packed(self, key: np.ndarray, columns: list[np.ndarray], pack=lambda *c: c) -> Iterator[pa.RecordBatch]:
        bucket = (key % np.uint64(self.buckets)).astype(np.uint32)
        order = np.argsort(bucket, kind="stable")
        edge = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        for k in np.flatnonzero(np.diff(edge)):
            own = order[edge[k] : edge[k + 1]]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([dumps(*pack(*(c[own] for c in columns)))], pa.binary())], names=["bucket", "data"])


DEALT = "bucket int, data binary"


def gathered(dealt: DataFrame, tasks: int, each, schema: str) -> DataFrame:
    """Give each bucket's arrays, joined, to each(arrays), which yields record batches.

    Buckets come one after another within a task; no more than one is held at a time.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in it:
            for bucket, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if bucket != at and held:
                    yield from each([np.concatenate(c) for c in zip(*held, strict=True)])
                    held = []
                at = bucket
                held.append(loads(data))
        if held:
            yield from each([np.concatenate(c) for c in zip(*held, strict=True)])

    return dealt.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)
