"""Lexical and dense retrieval, rank fusion, context expansion and diversification, for all questions at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import gram_text, grams, tokenize
from ..sources.store import kept

K1, B, RRF_K = 1.5, 0.75, 60


@dataclass(frozen=True)
class RetrievalPolicy:
    top_k: int = 6
    candidates: int = 24
    diversity: float = 0.35
    min_z: float = 1.0
    min_corpus_for_z: int = 8
    neighbor_window: int = 2
    neighbor_decay: float = 0.82

    def __post_init__(self):
        if self.top_k < 1 or not 0 <= self.diversity <= 1 or self.neighbor_window < 0 or not 0 < self.neighbor_decay <= 1:
            raise ValueError("invalid retrieval policy")


def postings(chunks: DataFrame) -> DataFrame:
    """chunk_id, len, term, tf: each text is tokenised once."""
    words = chunks.select("chunk_id", tokenize(F.col("text")).alias("words"))
    return words.select("chunk_id", F.size("words").alias("len"), F.explode("words").alias("term")).groupBy("chunk_id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))


def lengths(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", F.size(tokenize(F.col("text"))).alias("len"))


def small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """df marked for broadcast if it has no more than rows rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def term_stats(posts: DataFrame, n: Column) -> Column:
    return F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))


def removed_chunks(chunks: DataFrame, removed: DataFrame) -> DataFrame:
    """qid, chunk_id, text of the chunks whose documents a question goes without: removed has qid and doc_id."""
    return chunks.select("chunk_id", "text", F.col("doc_id").cast("string").alias("doc_id")).join(small(removed), "doc_id").select("qid", "chunk_id", "text")


def bm25(chunks: DataFrame, questions: DataFrame, limit: int = 24, gone: DataFrame | None = None) -> DataFrame:
    """qid, chunk_id, score, rank from 0. Only postings of asked terms go on; the question terms are the small side.

    gone (qid, chunk_id, text) lists what is not in a question's corpus: it is taken off the corpus statistics, so no corpus is built anew.
    """
    stats = lengths(chunks).agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("total"))
    asked = questions.select("qid", F.explode(tokenize(F.col("question"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("m"))
    posts = postings(chunks).join(small(asked.select("term").distinct()), "term", "left_semi")
    df = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    known = asked.join(df, "term").join(F.broadcast(stats))  # stats is one row and df a row for each asked term
    if gone is not None:
        less = gone.withColumn("len", F.size(tokenize(F.col("text")))).groupBy("qid").agg(F.count(F.lit(1)).alias("n0"), F.sum("len").alias("total0"))
        fewer = gone.select("qid", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("df0"))
        off = lambda a, b: (F.col(a) - F.coalesce(b, F.lit(0))).alias(a)
        known = known.join(less, "qid", "left").join(fewer, ["qid", "term"], "left").select("qid", "term", "m", off("df", "df0"), off("n", "n0"), off("total", "total0"))
    weighed = known.select("qid", "term", (F.col("total") / F.col("n")).alias("mean"), (F.col("m") * term_stats(posts, F.col("n"))).alias("idf"))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean"))
    scored = posts.join(weighed, "term")
    if gone is not None:
        scored = scored.join(gone.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")
    total = scored.groupBy("qid", "chunk_id").agg(F.sum(F.col("idf") * F.col("tf") * (K1 + 1) / norm).alias("score"))
    return ranked(total.filter("score > 0"), "score", limit)


def ranked(rows: DataFrame, score: str, limit: int) -> DataFrame:
    """The first rows of each qid, with rank from 0; the limit reaches the sort."""
    order = Window.partitionBy("qid").orderBy(F.desc(F.round(score, 9)), "chunk_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).withColumn("rank", F.col("rank") - 1)


def hashed_grams(texts: DataFrame, key: str, dims: int) -> DataFrame:
    """key, bucket, w: unit-length hashed gram vectors as sparse rows (md5 buckets, 1 + ln count weights)."""
    rows = texts.withColumn("_p", gram_text(F.col("text"))).select(key, F.explode(grams(F.col("_p"))).alias("g"))
    counted = rows.groupBy(key, "g").agg((1 + F.log(F.count(F.lit(1)).cast("double"))).alias("w"))
    bucket = F.conv(F.substring(F.md5("g"), 1, 8), 16, 10).cast("long") % dims
    summed = counted.groupBy(key, bucket.alias("bucket")).agg(F.sum("w").alias("w"))
    norm = summed.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return summed.join(norm, key).select(key, "bucket", (F.col("w") / F.col("norm")).alias("w"))


class GramHasher:
    """The vectors of hashed_grams for many keys at once, dense, without a row for each gram. Texts are those of gram_text.

    A gram is a number in base 37, and its bucket is kept once found: 143 MB if all grams there are occur, 4 kB for each opening of three letters.
    """

    LETTERS = b" 0123456789abcdefghijklmnopqrstuvwxyz"
    SIZES = (3, 4, 5)
    #: Above any gram's number; characters that are counted at once.
    TOP, CHARS = 27, 1 << 18

    def __init__(self, dims: int):
        if not 0 < dims < 1 << 16:
            raise ValueError("dims must be from 1 to 65535")
        self.dims, self.first, total = dims, {}, 0
        for n in self.SIZES:
            self.first[n] = total
            total += len(self.LETTERS) ** n
        self.known = np.zeros(total, np.uint16)  # bucket + 1, 0 if not looked up yet
        self.digit = np.zeros(256, np.int64)
        self.digit[np.frombuffer(self.LETTERS, np.uint8)] = np.arange(len(self.LETTERS))

    def gram(self, number: int) -> bytes:
        n = max(n for n in self.SIZES if self.first[n] <= number)
        number -= self.first[n]
        return bytes(self.LETTERS[number // len(self.LETTERS) ** i % len(self.LETTERS)] for i in reversed(range(n)))

    def buckets(self, numbers: np.ndarray) -> np.ndarray:
        found = self.known[numbers]
        if not found.all():
            for x in np.unique(numbers[found == 0]).tolist():
                self.known[x] = int.from_bytes(hashlib.md5(self.gram(x)).digest()[:4], "big") % self.dims + 1
            found = self.known[numbers]
        return found.astype(np.int64) - 1

    def vectors(self, keys: list[list[str]]) -> np.ndarray:
        """A row of length one for each key, whose texts count together; zero if they have no gram."""
        out, lo = np.zeros((len(keys), self.dims)), 0
        while lo < len(keys):
            hi, chars = lo, 0
            while hi < len(keys) and chars < self.CHARS:
                chars += sum(map(len, keys[hi]))
                hi += 1
            out[lo:hi] = self._weights(keys[lo:hi])
            lo = hi
        norm = np.sqrt(np.einsum("ij,ij->i", out, out))
        return out / np.where(norm == 0, 1, norm)[:, None]

    def _weights(self, keys: list[list[str]]) -> np.ndarray:
        texts = [t for k in keys for t in k]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        key = np.repeat(np.repeat(np.arange(len(keys)), [len(k) for k in keys]), size) << self.TOP
        left = np.repeat(np.cumsum(size), size) - np.arange(len(key))  # characters from each one to the end of its text
        digit = self.digit[np.frombuffer("".join(texts).encode(), np.uint8)]
        number, rows = digit, []
        for n in range(2, max(self.SIZES) + 1):
            number = number[:-1] * len(self.LETTERS) + digit[n - 1 :]
            if n in self.SIZES:
                whole = left[: len(number)] >= n
                rows.append((key[: len(number)] + number)[whole] + self.first[n])
        seen, counts = np.unique(np.concatenate(rows), return_counts=True)
        at = (seen >> self.TOP) * self.dims + self.buckets(seen & (1 << self.TOP) - 1)
        return np.bincount(at, 1 + np.log(counts), len(keys) * self.dims).reshape(-1, self.dims)


def sparse_cosine(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """left, right, cosine of all pairs that share a bucket."""
    return a.join(b.withColumnRenamed("w", "v"), "bucket").groupBy(left, right).agg(F.sum(F.col("w") * F.col("v")).alias("cosine"))


#: Bytes of question vectors that meet the chunks in one pass.
QUESTION_BYTES = 64 << 20


def nearest(vectors: DataFrame, asked: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(qid, chunk_id, cosine): the first chunks of each question; (qid, n, total, square): moments of its cosines over all chunks.

    vectors has chunk_id and vec, asked qid and vec, all of length one. Products are of whole blocks; a task keeps no more than
    limit chunks of a question. Questions beyond QUESTION_BYTES go in several passes.
    """
    d = (asked.select(F.size("vec")).first() or [1])[0]
    passes = -(-asked.count() * d * 8 // QUESTION_BYTES)
    parts = [_nearest(vectors, asked.filter(F.pmod(F.xxhash64("qid"), F.lit(passes)) == i) if passes > 1 else asked, limit) for i in range(max(1, passes))]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    top = ranked(both.filter("chunk_id is not null").select("qid", "chunk_id", F.col("a").alias("cosine")), "cosine", limit)
    moments = both.filter("chunk_id is null").groupBy("qid").agg(F.sum("n").alias("n"), F.sum("a").alias("total"), F.sum("b").alias("square"))
    return top.drop("rank"), moments


def _nearest(vectors: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    questions = asked.select("qid", "vec").toPandas()
    names = questions["qid"].to_numpy()
    q = np.stack(questions["vec"]).astype(float) if len(questions) else np.zeros((0, 1))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = [None] * len(q)
        n, total, square = 0, np.zeros(len(q)), np.zeros(len(q))
        for frame in it:
            for lo in range(0, len(frame), 4096):
                part = frame.iloc[lo : lo + 4096]
                x, ids = np.stack(part["vec"]).astype(float), part["chunk_id"].to_numpy()
                for k in range(0, len(q), 1024):
                    cosine = q[k : k + 1024] @ x.T
                    total[k : k + 1024] += cosine.sum(1)
                    square[k : k + 1024] += (cosine * cosine).sum(1)
                    near = np.round(cosine, 9)
                    for i in range(len(near)):
                        at = np.arange(len(ids))
                        if len(ids) > limit:
                            at = np.flatnonzero(near[i] >= -np.partition(-near[i], limit - 1)[limit - 1])
                        c, r, o = cosine[i][at], near[i][at], ids[at]
                        if held[k + i] is not None:
                            c, r, o = (np.concatenate(v) for v in zip(held[k + i], (c, r, o), strict=True))
                        best = np.lexsort((o, -r))[:limit]
                        held[k + i] = (c[best], r[best], o[best])
                n += len(ids)
        for i, h in enumerate(held):
            if h is not None:
                yield pd.DataFrame({"qid": names[i], "chunk_id": h[2], "n": 0, "a": h[0], "b": 0.0})
        if n:
            yield pd.DataFrame({"qid": names, "chunk_id": None, "n": n, "a": total, "b": square})

    kind = {f.name: f.dataType.simpleString() for f in (*vectors.schema.fields, *asked.schema.fields)}
    return vectors.select("chunk_id", "vec").mapInPandas(run, f"qid {kind['qid']}, chunk_id {kind['chunk_id']}, n long, a double, b double")


def dense(near: DataFrame, moments: DataFrame, policy: RetrievalPolicy) -> DataFrame:
    """qid, chunk_id, score, rank: top candidates above the mean by min_z population deviations over all chunks (as from nearest)."""
    mean = F.col("total") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("square") / F.col("n") - mean * mean, F.lit(0.0)))
    floor = F.when((F.col("n") < policy.min_corpus_for_z) | (spread < 1e-9), F.lit(0.0)).otherwise(mean + policy.min_z * spread)
    rows = ranked(near, "cosine", policy.candidates).join(moments.select("qid", floor.alias("floor")), "qid")
    return rows.filter((F.col("cosine") > 0) & (F.col("cosine") >= F.col("floor"))).select("qid", "chunk_id", F.col("cosine").alias("score"), "rank")


def fuse(lexical: DataFrame, vector: DataFrame) -> DataFrame:
    """Reciprocal ranks summed; both ranks kept. seq is the order of insertion: lexical first, then dense only."""
    a = lexical.select("qid", "chunk_id", F.col("rank").alias("lexical_rank"))
    b = vector.select("qid", "chunk_id", F.col("rank").alias("dense_rank"))
    both = a.join(b, ["qid", "chunk_id"], "full")
    part = lambda c: F.coalesce(1.0 / (RRF_K + 1 + F.col(c)), F.lit(0.0))
    return both.withColumn("score", part("lexical_rank") + part("dense_rank")).withColumn("seq", F.coalesce("lexical_rank", F.col("dense_rank") + 1_000_000))


def expand(fused: DataFrame, chunks: DataFrame, policy: RetrievalPolicy) -> DataFrame:
    """Scores of chunks within the window of a hit rise to its decayed score; offsets are exploded, so the join is by equality.

    Adds promoted and orders ties by own hits, then by the hit, distance and side that reached a neighbour.
    """
    place = chunks.select("chunk_id", "doc_id", "ordinal")
    seeds = fused.join(place, "chunk_id")
    offsets = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(s).alias("s")) for d in range(1, policy.neighbor_window + 1) for s in (-1, 1)))
    if policy.neighbor_window == 0:
        return fused.withColumn("promoted", F.lit(False))
    reach = seeds.select("qid", "doc_id", "score", "ordinal", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("seq"), "chunk_id")).alias("from"), F.explode(offsets).alias("o"))
    reach = reach.select("qid", "doc_id", (F.col("ordinal") + F.col("o.d") * F.col("o.s")).alias("ordinal"), (F.col("score") * F.pow(F.lit(policy.neighbor_decay), F.col("o.d"))).alias("near"), (2_000_000 + F.col("from") * 100 + F.col("o.d") * 2 + (F.col("o.s") + 1) / 2).alias("by"))
    best = reach.join(place, ["doc_id", "ordinal"]).groupBy("qid", "chunk_id").agg(F.max("near").alias("near"), F.min("by").alias("by"))
    out = fused.join(best, ["qid", "chunk_id"], "full")
    own = F.coalesce("score", F.lit(0.0))
    return out.select("qid", "chunk_id", F.greatest(own, F.coalesce("near", F.lit(0.0))).alias("score"), "lexical_rank", "dense_rank", F.coalesce(F.col("seq").cast("double"), "by").alias("seq"), F.coalesce(F.col("near") > own, F.lit(False)).alias("promoted"))


def mmr(pool: list[tuple[float, np.ndarray, bool]], k: int, diversity: float) -> list[int]:
    """Greedy picks from a ranked pool of (relevance, unit vector, promoted): the first, then the best trade-offs."""
    if diversity == 0 or not pool:
        return list(range(min(k, len(pool))))
    rel = np.array([p[0] for p in pool])
    x = np.stack([p[1] for p in pool])
    weight = np.where([p[2] for p in pool], 0.1, 1.0)
    like, chosen = x @ x.T, [0]
    while len(chosen) < min(k, len(pool)):
        value = (1 - diversity) * rel - diversity * weight * like[:, chosen].max(1)
        value[chosen] = -np.inf
        chosen.append(int(np.argmax(np.round(value, 12))))
    return chosen


def diversify(ranked: DataFrame, policy: RetrievalPolicy) -> DataFrame:
    """qid, chunk_id, score, position from rows (qid, chunk_id, place, relevance, promoted, vector) of each question's pool."""
    size = max(policy.candidates, policy.top_k)

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        pool = list(zip(group["relevance"], map(np.asarray, group["vector"]), group["promoted"], strict=True))
        at = mmr(pool, policy.top_k, policy.diversity)
        return group.iloc[at][["qid", "chunk_id", "score"]].assign(position=range(len(at)))

    kinds = {f.name: f.dataType.simpleString() for f in ranked.schema.fields}
    return ranked.filter(F.col("place") < size).groupBy("qid").applyInPandas(pick, f"qid {kinds['qid']}, chunk_id {kinds['chunk_id']}, score double, position int")


def search(chunks: DataFrame, questions: DataFrame, embed, policy: RetrievalPolicy | None = None, removed: DataFrame | None = None) -> DataFrame:
    """What each question retrieves: qid, position, chunk_id, doc_id, ordinal, text, score, lexical_rank, dense_rank.

    chunks has chunk_id, doc_id, ordinal and text, questions qid and question; embed gives (text, vec) of distinct texts. Equal scores
    keep the order in which lexical hits, dense hits and their neighbours came up. A question without hits has no rows. removed
    (qid, doc_id) lists documents that a question searches without, as if its corpus had never held them.
    """
    policy = policy or RetrievalPolicy()
    asked = questions.select("qid", F.col("question").alias("text"))
    vectors = kept(embed(chunks.select("text").unionByName(asked.select("text")).distinct()))
    placed = chunks.select("chunk_id", "text").join(vectors, "text").select("chunk_id", "vec")
    asked = asked.join(vectors, "text").select("qid", "vec")
    gone = None if removed is None else removed_chunks(chunks, removed)
    if gone is None:
        near, moments = nearest(placed, asked, policy.candidates)
    else:
        most = gone.groupBy("qid").count().agg(F.max("count")).first()[0] or 0
        near, moments = nearest(placed, asked, policy.candidates + most)
        near = near.join(gone.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")
        own = gone.join(placed, "chunk_id").join(asked.withColumnRenamed("vec", "asked"), "qid").select("qid", dot(F.col("asked"), F.col("vec")).alias("c"))
        less = own.groupBy("qid").agg(F.count(F.lit(1)).alias("n0"), F.sum("c").alias("total0"), F.sum(F.col("c") * F.col("c")).alias("square0"))
        off = lambda a: (F.col(a) - F.coalesce(f"{a}0", F.lit(0))).alias(a)
        moments = moments.join(less, "qid", "left").select("qid", off("n"), off("total"), off("square"))
    fused = fuse(bm25(chunks, questions, policy.candidates, gone), dense(near, moments, policy))
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 12)), "seq", "chunk_id")
    size = max(policy.candidates, policy.top_k)
    pool = kept(expand(fused, chunks, policy).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= size).withColumn("place", F.col("place") - 1))
    mine = asked.withColumnRenamed("vec", "asked")
    full = pool.join(placed.withColumnRenamed("vec", "vector"), "chunk_id").join(mine, "qid").withColumn("relevance", dot(F.col("asked"), F.col("vector")))
    picked = diversify(full.select("qid", "chunk_id", "place", "relevance", "promoted", "vector", "score"), policy)
    ranks = pool.select("qid", "chunk_id", "lexical_rank", "dense_rank")
    return picked.join(ranks, ["qid", "chunk_id"]).join(chunks.select("chunk_id", "doc_id", "ordinal", "text"), "chunk_id").select("qid", "position", "chunk_id", "doc_id", "ordinal", "text", "score", "lexical_rank", "dense_rank")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """Length one; zero vectors stay. The outer array has the norm computed once, not for each element."""
    norm = F.array(F.sqrt(dot(v, v)))
    return F.element_at(F.transform(norm, lambda n: F.transform(v, lambda x: x / F.when(n == 0, 1.0).otherwise(n))), 1)


def gram_vectors(texts: DataFrame, dims: int = 512, digest: str = "md5") -> DataFrame:
    """text with vec of length one: 1 + ln count of its grams, summed in buckets of their 4-byte md5 or blake2b digests."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib
        import re
        from collections import Counter

        make = (lambda g: hashlib.md5(g).digest()[:4]) if digest == "md5" else (lambda g: hashlib.blake2b(g, digest_size=4).digest())
        known: dict[str, int] = {}
        for b in it:
            out = []
            for text in b["text"]:
                p = f" {' '.join(re.findall('[a-z0-9]+', (text or '').lower()))} "
                counts = Counter(p[i : i + n] for n in (3, 4, 5) for i in range(len(p) - n + 1))
                if len(known) > 500_000:
                    known.clear()
                for g in counts.keys() - known.keys():
                    known[g] = int.from_bytes(make(g.encode()), "big") % dims
                at = np.fromiter(map(known.__getitem__, counts), int, len(counts))
                v = np.bincount(at, 1 + np.log(np.fromiter(counts.values(), float, len(counts))), dims)
                out.append(v / (np.linalg.norm(v) or 1))
            yield pd.DataFrame({"text": b["text"], "vec": out})

    return texts.select("text").distinct().mapInPandas(run, "text string, vec array<double>")


def blake_vectors(texts: DataFrame, dims: int = 512) -> DataFrame:
    return gram_vectors(texts, dims, "blake2b").withColumn("vec", F.col("vec").cast("array<float>"))


def embed_missing(texts: DataFrame, cache: DataFrame, embed) -> DataFrame:
    """The cache with vectors of the distinct texts that it lacks."""
    return cache.unionByName(embed(texts.select("text").distinct().join(cache, "text", "left_anti")))


def cached(cache: DataFrame, embed):
    """An embedder that asks embed only for texts that cache lacks, and gives just the texts asked for."""
    return lambda texts: embed_missing(texts, cache, embed).join(texts.select("text").distinct(), "text", "left_semi")


def frozen(cache: DataFrame):
    """An embedder of recorded vectors; a text without one raises."""

    def embed(texts: DataFrame) -> DataFrame:
        missing = texts.select("text").distinct().join(cache, "text", "left_anti").limit(1).collect()
        if missing:
            raise LookupError(f"no recorded vector for {missing[0][0][:80]!r}")
        return cache.join(texts.select("text").distinct(), "text", "left_semi")

    return embed


def cache_use(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """hits and misses: rows of texts whose vector the cache has, and distinct texts that it lacks."""
    known = texts.select("text").join(cache.select("text", F.lit(True).alias("hit")), "text", "left")
    return known.agg(F.count("hit").alias("hits"), F.count_distinct(F.when(F.col("hit").isNull(), F.col("text"))).alias("misses"))


#: Names of embedders and their dimensions by default.
EMBEDDERS = {"ngram": 512, "ngram-md5": 512}


def embedder(name: str = "ngram", dims: int | None = None, cache: DataFrame | None = None):
    """An embedder by name (with its identity as .identity), which asks only for what cache lacks if there is one."""
    if name not in EMBEDDERS:
        raise ValueError(f"unknown embedder {name!r}; there are {', '.join(EMBEDDERS)}")
    size = dims or EMBEDDERS[name]
    own = lambda texts: gram_vectors(texts, size, "blake2b" if name == "ngram" else "md5")
    out = cached(cache, own) if cache is not None else own
    out.identity = f"{name}-{size}"
    return out


def vectors_for(vectors: DataFrame, wanted: DataFrame, key: str = "chunk_id") -> DataFrame:
    """wanted with the vectors of its keys; a key that has none raises."""
    missing = wanted.join(vectors, key, "left_anti").select(key).limit(1).collect()
    if missing:
        raise LookupError(f"no vector for {missing[0][0]}")
    return wanted.join(vectors, key)


def batched(call, size: int = 96, attempts: int = 4, most: float = 8.0, retry=(ConnectionError, TimeoutError)):
    """An embedder from call(list of texts) -> list of vectors, as a remote service has: Arrow batches are cut to size texts, and
    an error of the kinds in retry is tried again after a growing pause with jitter. Nothing here opens a connection itself."""

    def embed(texts: DataFrame) -> DataFrame:
        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in it:
                for lo in range(0, len(b), size):
                    part = b["text"].iloc[lo : lo + size].tolist()
                    got = np.asarray(retried(lambda part=part: call(part), attempts, most, retry), float)
                    norm = np.linalg.norm(got, axis=1, keepdims=True)
                    yield pd.DataFrame({"text": part, "vec": list(got / np.where(norm == 0, 1, norm))})

        return texts.select("text").distinct().mapInPandas(run, "text string, vec array<double>")

    return embed


def retried(act, attempts: int = 4, most: float = 8.0, retry=(ConnectionError, TimeoutError)):
    """act(), tried again after errors of the kinds in retry, with pauses that double up to most seconds."""
    import random
    import time

    for i in range(attempts):
        try:
            return act()
        except retry:
            if i + 1 == attempts:
                raise
            time.sleep(min(most, 0.5 * 2**i) * random.random())


def project(vectors: DataFrame, key: str, column: str = "embedding") -> DataFrame:
    """key, x, y, explained: the first two principal components. Moments are one aggregation of d x d sums."""
    d = len(vectors.select(column).first()[0])
    m = vectors.select(F.posexplode(column).alias("i", "x"), F.col(key)).groupBy("i").agg(F.avg("x").alias("mean")).orderBy("i").collect()
    mean = np.array([r["mean"] for r in m])

    def sums(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros((d, d))
        for b in it:
            x = np.stack(b[column]).astype(float) - mean
            acc += x.T @ x
        yield pd.DataFrame({"i": np.repeat(np.arange(d), d), "j": np.tile(np.arange(d), d), "s": acc.ravel()})

    got = vectors.select(column).mapInPandas(sums, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    cov = np.zeros((d, d))
    for r in got:
        cov[r["i"], r["j"]] = r["s"]
    value, axes = np.linalg.eigh(cov)
    axes = axes[:, ::-1][:, :2]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), range(axes.shape[1])])
    share = float(value[::-1][:2].sum() / value.sum()) if value.sum() else 0.0
    out = [F.lit(0.0)] * 2
    for k in range(axes.shape[1]):
        out[k] = dot(F.zip_with(F.col(column), F.array(*map(F.lit, mean.tolist())), lambda x, y: x - y), F.array(*map(F.lit, axes[:, k].tolist())))
    return vectors.select(key, out[0].alias("x"), out[1].alias("y"), F.lit(round(share, 4)).alias("explained"))
