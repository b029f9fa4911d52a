"""Approximate nearest neighbours by adaptive dimension scan within probed lists.

An inverted file is fitted on a bounded sample and indexes every vector. Vectors and queries are turned
by one random rotation, so that a prefix of their dimensions is a fair sample of the rest. A list is
scanned in column blocks: lengths are known, so the query's 20th best product is a distance for each candidate, and after each block a
candidate is abandoned if the share of its distance seen so far is too large, by Z deviations, for that distance. Survivors
are scored exactly on the original vectors in double precision.

Equal vectors are one candidate with their 21 smallest vec_ids (no query can return more of them), so a
very common vector costs as much as any other. Large lists are split in blocks of vectors and queries.

Fixed behaviour: null vectors, zero vectors, vectors with null or non-finite components, rows without a
vec_id and vectors whose length is not the most common one take no part; ties go to the smaller vec_id;
repeated rows count once; fewer candidates than 20 are all returned if their lists are probed, and all
lists are while there are at most ``probes``; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Scratch

K, EVERY = 20, 20
#: The sample that fits the lists, the most lists there are, k-means rounds.
SAMPLE, MAX_LISTS, ROUNDS = 65_536, 65_536, 8
#: Share of the lists that a query probes (PROBES at least), dimensions of a column block, deviations of the test (of a length seen in b dimensions, in units of it over the root of b).
SHARE, PROBES, COLUMNS, Z = 0.62, 24, 16, 2.1
#: Vectors and queries that meet in one task.
BLOCK_VECTORS, BLOCK_QUERIES = 4096, 4096
#: Products with centres that a task holds at once.
TABLE = 1 << 21


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part."""
    v = F.col("embedding")
    rows = vectors.select("vec_id", v.cast("array<double>").alias("embedding")).filter("vec_id is not null and embedding is not null")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.filter(fine).withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))
    size = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.filter(F.size("embedding") == (size[0]["d"] if size else 0))


def rotation(d: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def fit_lists(sample: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Unit centroids by k-means on directions."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    rng = np.random.default_rng(seed)
    centres = unit[rng.choice(len(unit), min(lists, len(unit)), replace=False)]
    for _ in range(ROUNDS):
        own = np.concatenate([(unit[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(unit), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return centres


def scan(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, turn: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the k best of x by the adaptive scan: query index, positions, exact scores."""
    d = x.shape[1]
    turned, asked = x @ turn, queries @ turn
    edges = [*range(0, d, COLUMNS), d]
    blocks = [np.ascontiguousarray(turned[:, a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    grown = np.cumsum(np.stack([(b * b).sum(1) for b in blocks]), axis=0)  # squared lengths up to the end of each block
    first = np.argsort(-grown[-1], kind="stable")[: 2 * k]
    for qi, (q, t) in enumerate(zip(queries, asked, strict=True)):
        seeds = x[first] @ q
        limit = np.partition(seeds, -k)[-k] if len(seeds) >= k else -np.inf
        own = np.cumsum(t * t)
        alive, partial = None, 0.0
        for i, block in enumerate(blocks):
            a, b = edges[i], edges[i + 1]
            partial = partial + (block if alive is None else block[alive]) @ t[a:b]
            if b < d:
                if len(partial) > 4 * k:  # the best so far by partial products sharpen the limit exactly
                    lead = np.argpartition(partial, -k)[-k:]
                    lead = lead if alive is None else alive[lead]
                    limit = max(limit, np.partition(x[lead] @ q, 0)[0])
                if limit == -np.inf:
                    continue
                so_far, whole = (grown[i], grown[-1]) if alive is None else (grown[i][alive], grown[-1][alive])
                # A product of limit is a squared distance of most; b of d turned dimensions show b / d of it, give or take.
                most = own[-1] + whole - 2 * limit
                stay = np.flatnonzero(own[b - 1] + so_far - 2 * partial <= most * min(1.0, (1 + Z / np.sqrt(b)) ** 2 * b / d) + 1e-9 * whole)
                alive = stay if alive is None else alive[stay]
                partial = partial[stay]
        found = alive if alive is not None else np.arange(len(x))
        score = x[found] @ q
        order = np.lexsort((ids[found], -score))[:k]
        yield qi, found[order], score[order]


def search(spark: SparkSession, vectors: DataFrame, k: int = K, every: int = EVERY, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by every."""
    scratch = Scratch(spark)
    rows = scratch.write(valid(vectors).distinct())
    first = Window.partitionBy("embedding").orderBy("vec_id")
    ids = rows.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1)
    unique = ids.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    unique = scratch.write(unique.select(F.col("ids")[0].alias("uid"), "ids", "embedding"))
    n = unique.count()
    queries = rows.filter(F.col("vec_id") % every == 0)
    asked = queries.join(unique.select("uid", "embedding"), "embedding").select(F.col("vec_id").alias("query_id"), "uid")
    asked = scratch.write(asked)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    # A threshold on hashes draws about SAMPLE vectors where they are; nothing is sorted in one task.
    span = 1 << 30
    picked = unique.filter(F.pmod(F.xxhash64("uid"), F.lit(span)) <= span * min(1.0, SAMPLE / n)).select("uid", "embedding").toPandas().sort_values("uid")["embedding"]
    if not len(picked):
        picked = unique.orderBy("uid").limit(1).toPandas()["embedding"]
    centres = fit_lists(np.array(picked.tolist(), float), min(MAX_LISTS, max(1, isqrt(n))))
    probes = min(len(centres), max(PROBES, ceil(share * len(centres))))
    turn = rotation(centres.shape[1])
    shared = spark.sparkContext.broadcast(centres)  # MAX_LISTS vectors at most
    step = max(1, TABLE // len(centres))

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = np.array(b.column(1).to_pylist(), float).reshape(len(b), -1)
            centres = shared.value
            own = np.concatenate([(x[i : i + step] @ centres.T).argmax(1) for i in range(0, len(x), step)]) if len(b) else []
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), b.column(0), pa.array([v.tobytes() for v in x], pa.binary())], names=["list", "uid", "v"])

    def ask(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = np.array(b.column(1).to_pylist(), float).reshape(len(b), -1)
            if not len(b):
                continue
            centres = shared.value
            for i in range(0, len(x), step):
                part = x[i : i + step]
                near = np.argpartition(-(part @ centres.T), probes - 1, axis=1)[:, :probes]
                at = pa.array(np.repeat(np.arange(len(part)), probes))
                raw = pa.array([v.tobytes() for v in part], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel(), pa.int32()), b.column(0).slice(i, len(part)).take(at), raw.take(at)], names=["list", "q", "v"])

    placed = scratch.write(unique.select("uid", "embedding").mapInArrow(place, "list int, uid long, v binary"))
    distinct_asked = asked.select("uid").distinct()
    probed = scratch.write(unique.select("uid", "embedding").join(distinct_asked, "uid").mapInArrow(ask, "list int, q long, v binary"))
    sizes = placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_VECTORS).alias("nv")).join(probed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).alias("nq")), "list")
    left = placed.join(sizes, "list").select("list", F.pmod(F.xxhash64("uid"), "nv").alias("bv"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq") - 1)).alias("bq"), "uid", "v")
    right = probed.join(sizes, "list").select("list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nv") - 1)).alias("bv"), F.pmod(F.xxhash64("q"), "nq").alias("bq"), "q", "v")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "uid": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        x = np.frombuffer(b"".join(a["v"]), float).reshape(len(a), -1)
        y = np.frombuffer(b"".join(b["v"]), float).reshape(len(b), -1)
        uid, q = a["uid"].to_numpy(), b["q"].to_numpy()
        got = list(scan(x, uid, y, turn, k + 1))
        return pd.DataFrame({"q": np.concatenate([np.full(len(p), q[i]) for i, p, _ in got]), "uid": np.concatenate([uid[p] for _, p, _ in got]), "score": np.concatenate([s for _, _, s in got])})

    keys = ["list", "bv", "bq"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "q long, uid long, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "uid")
    found = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1)
    named = found.join(unique.select("uid", "ids"), "uid").select("q", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    lists = named.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))
    out = asked.join(lists, F.col("uid") == F.col("q"))
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return out.select("query_id", F.posexplode(others).alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
