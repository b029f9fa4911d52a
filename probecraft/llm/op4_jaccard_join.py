"""Exact Jaccard join of word 5-gram sets with signature trees.

1. Each text becomes a set of 56-bit shingle hashes; equal sets are one class. A task deals a class once, under a number of its own.
2. Shingles are dealt by hash; one that only a single number has is private. A class can only link if no more
   of its shingles are private than a linked partner may lack, so all others are done at once. A shingle that HOT numbers of one deal
   have is dealt by shingle and number, and marked for the others, so that no bucket gets all of them.
3. Classes that may link are dealt to shards so that linked ones meet: each points from its rarest shared shingles to the smallest
   class that lists them too (prefix filter in one global order), and no link leaves a connected component of these pointers.
   Many components share a shard; nothing but the shard follows from them.
4. A shard gets a signature tree: leaves of classes in order of size and signature, nodes with the OR of their bitmaps and
   their range of sizes. A dual traversal, a level at a time, skips a pair of nodes if the largest overlap that its bitmaps and sizes allow
   is too small, or if all of both is one component already; what is left of the pairs of leaves is compared exactly.
5. A component above BLOCK classes is dealt out in pieces by size: its classes are first compared with a few pivots of it, and
   those that stay apart from the main component meet the pieces whose range of sizes allows links, a pair of pieces at a time.

``links`` gives all links between classes and their members; ``join`` skips pairs that are one component already.

Fixed behaviour: texts without words, or null, have empty sets and link with nothing; repeated rows of a doc_id
are one document in links and each in the result; a row without doc_id links like any other, but its component_id is
null and it names no component; empty tables give empty results; ties don't matter, as all links count; very long texts are whole;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Dealer, Scratch, components, file_bytes, gathered, loads, mix, partitions, settled, spread_join, windows, word_sequences

#: Words of a shingle; 100 * intersection >= PERCENT * union links.
WORDS, PERCENT = 5, 75
#: Classes of a component that one task takes whole, and of a shard, about; classes of a leaf; children of a node.
BLOCK, LEAF, FAN = 2048, 4, 4
#: Bits of a bitmap for each shingle of a mean set; least and most 64-bit words of a bitmap; pairs looked at together.
BITS, LEAST_WORDS, MOST_WORDS, PAIRS = 32, 16, 1024, 2048
PIVOT_ROUNDS = 4
#: Classes of one deal from which a shingle is dealt by class; MB of files for each bucket.
HOT, BUCKET_MB = 16, 3
#: Rarity of a hot shingle, after all others; bytes of a shingle's hash.
COMMON, WIDTH = 255, 7


def sets_of(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, sorted distinct shingles of texts one after another, where each text's begin and the last end)."""
    for lo, hi, owner, h in word_sequences(texts):
        many = np.bincount(owner, minlength=hi - lo)
        s = windows(h, WORDS) >> np.uint64(64 - 8 * WIDTH)
        inside = owner[: len(s)] == owner[WORDS - 1 :]
        s, o = s[inside], owner[: len(s)][inside]
        few = np.flatnonzero((many > 0) & (many < WORDS))
        if len(few):
            end = np.cumsum(many)
            whole = [windows(np.append(h[end[i] - many[i] : end[i]], np.uint64(many[i])), int(many[i]) + 1) >> np.uint64(64 - 8 * WIDTH) for i in few]
            s, o = np.concatenate([s, *whole]), np.concatenate([o, few])
        order = np.lexsort((s, o))
        s, o = s[order], o[order]
        new = np.concatenate([[True], (s[1:] != s[:-1]) | (o[1:] != o[:-1])])[: len(s)]
        yield lo, s[new], np.searchsorted(o[new], np.arange(hi - lo + 1))


def set_of(text: str | None) -> np.ndarray:
    return next((s for _, s, _ in sets_of([_plain(text)])), np.empty(0, np.uint64))


def _plain(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def names_of(s: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """A 63-bit name of each set, -1 for empty ones."""
    n = np.diff(edge)
    out = np.full(len(n), -1, np.int64)
    if len(s):
        full = n > 0
        one, two = (np.add.reduceat(x, edge[:-1][full]) for x in (mix(s), mix(s * np.uint64(0x9E3779B97F4A7C15))))
        out[full] = (mix(one ^ (two * np.uint64(3) + n[full].astype(np.uint64))) >> np.uint64(1)).view(np.int64)
    return out


def spare(n: np.ndarray | int, percent: int = PERCENT):
    """Shingles that a set of n may lack in a linked partner."""
    return n - (n * percent + 99) // 100


def linked(inter: int, a: int, b: int, percent: int = PERCENT) -> bool:
    return 100 * inter >= percent * (a + b - inter)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


class Forest:
    """Union of numbers, each component named by its smallest."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def labels(self) -> np.ndarray:
        up = np.array(self.up, np.int64)
        while (up[up] != up).any():
            up = up[up]
        return up


class SignatureTree:
    """Leaves and nodes over sets in order of size and signature.

    sets are what classes share with others, sizes count private shingles too. ``seen`` counts pairs of nodes, those that
    sizes, bitmaps and components pruned, pairs of sets that were left, and those compared exactly.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, percent: int = PERCENT):
        self.sets, self.sizes, self.percent = sets, sizes, percent
        self.lengths = np.fromiter(map(len, sets), np.int64, len(sets))
        words = int(np.clip(1 << int(np.ceil(np.log2(max(1.0, self.lengths.mean() * BITS / 64)))), LEAST_WORDS, MOST_WORDS))
        flat = np.concatenate(sets) % np.uint64(64 * words)
        bits = np.zeros(len(sets) * words, np.uint64)
        np.bitwise_or.at(bits, np.repeat(np.arange(len(sets)) * words, self.lengths) + (flat >> np.uint64(6)).astype(np.int64), np.uint64(1) << (flat & np.uint64(63)))
        self.bits = bits.reshape(len(sets), words)
        lows = np.array([s[0] if len(s) else 0 for s in sets], np.uint64)
        self.order = np.lexsort((lows, np.log2(np.maximum(sizes, 1)) // 0.2))
        # Shingles of a set that fall on a bit of another one of it: an overlap has no more than common bits and these.
        doubled = self.lengths - np.bitwise_count(self.bits).sum(1, dtype=np.int64)
        at = np.arange(0, len(sets), LEAF)
        level = [f.reduceat(x[self.order], at, axis=0) for f, x in ((np.bitwise_or, self.bits), (np.minimum, sizes), (np.maximum, sizes), (np.maximum, doubled))]
        self.levels = [(at, *level)]  # first place of each node, bitmaps, smallest and largest size, most doubled
        while len(at) > 1:
            up = np.arange(0, len(at), FAN)
            level = [f.reduceat(x, up, axis=0) for f, x in zip((np.bitwise_or, np.minimum, np.maximum, np.maximum), level, strict=True)]
            at = at[up]
            self.levels.append((at, *level))
        self.seen = dict.fromkeys(("nodes", "by_size", "by_bitmap", "by_component", "left", "compared"), 0)

    def allowed(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether sets below nodes i and j could overlap enough: the smallest sets need the least."""
        _, bits, small, large, doubled = self.levels[level]
        fits = (large[i] * 100 >= small[j] * self.percent) & (large[j] * 100 >= small[i] * self.percent)
        self.seen["nodes"] += len(i)
        self.seen["by_size"] += int((~fits).sum())
        at = np.flatnonzero(fits & (i != j))
        most = np.bitwise_count(bits[i[at]] & bits[j[at]]).sum(1, dtype=np.int64) + np.minimum(doubled[i[at]], doubled[j[at]])
        fits[at] = most * 100 >= self.percent * np.maximum(small[i[at]], small[j[at]])
        self.seen["by_bitmap"] += int((~fits[at]).sum())
        return fits

    def pair_allowed(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether two sets' bitmaps and sizes allow a link: a bit that only one has is a shingle that the other lacks."""
        x, y, n = self.bits[p], self.bits[q], self.sizes
        most = np.minimum(self.lengths[p] - np.bitwise_count(x & ~y).sum(1, dtype=np.int64), self.lengths[q] - np.bitwise_count(y & ~x).sum(1, dtype=np.int64))
        return 100 * most >= self.percent * (n[p] + n[q] - most)

    def linked(self, p: int, q: int) -> bool:
        self.seen["compared"] += 1
        return linked(overlap(self.sets[p], self.sets[q]), int(self.sizes[p]), int(self.sizes[q]), self.percent)


def traverse(tree: SignatureTree, forest: Forest | None = None, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Linked pairs of sets by a dual traversal of a tree with itself.

    With forest, which they join, pairs of one component are skipped. With side, only pairs of a True and any other are needed.
    """
    order, top, found = tree.order, len(tree.levels) - 1, []

    def compare(p: np.ndarray, q: np.ndarray) -> None:
        for a in range(0, len(p), PAIRS):
            x, y = p[a : a + PAIRS], q[a : a + PAIRS]
            tree.seen["left"] += len(x)
            keep = tree.pair_allowed(x, y)
            for u, v in zip(x[keep].tolist(), y[keep].tolist(), strict=True):
                if (forest is None or forest.find(u) != forest.find(v)) and tree.linked(u, v):
                    found.append((u, v))
                    if forest is not None:
                        forest.join(u, v)

    def needed(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        fine = (p != q) if side is None else (p != q) & (side[p] | side[q])
        if forest is not None:
            label = forest.labels()
            fine &= label[p] != label[q]
        return fine

    if forest is not None and len(order) > 1:  # neighbours first, so that groups of near copies are soon one component
        ok = needed(order[:-1], order[1:])
        compare(order[:-1][ok], order[1:][ok])
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        keep = tree.allowed(level, i, j)
        i, j = i[keep], j[keep]
        at = tree.levels[level][0]
        if forest is not None and len(i):
            label = forest.labels()[order]
            low, high = np.minimum.reduceat(label, at), np.maximum.reduceat(label, at)
            one = (low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j])
            tree.seen["by_component"] += int(one.sum())
            i, j = i[~one], j[~one]
        if side is not None and len(i):
            any_ = np.logical_or.reduceat(side[order], at)
            keep = any_[i] | any_[j]
            i, j = i[keep], j[keep]
        if not len(i):
            continue
        wide, below = (FAN, len(tree.levels[level - 1][0])) if level else (LEAF, len(order))
        grid = np.arange(wide)
        a = (i[:, None, None] * wide + grid[:, None] + 0 * grid).ravel()
        b = (j[:, None, None] * wide + grid + 0 * grid[:, None]).ravel()
        keep = (a < below) & (b < below) & (a <= b)
        a, b = a[keep], b[keep]
        if level:
            stack += [(level - 1, a[k : k + PAIRS], b[k : k + PAIRS]) for k in range(0, len(a), PAIRS)][::-1]
        else:
            p, q = order[a], order[b]
            keep = needed(p, q)
            compare(p[keep], q[keep])
    return found


def classes(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, cls) of every document, and (cls, n, shared, prefix) of the classes that may link.

    The second has the class's shingles that others have too, sorted, and the rarest of them.
    """
    given = docs.select("doc_id", "text")
    docs = settled(given, scratch)
    n_parts = partitions(docs.sparkSession, docs, 64)
    buckets = max(n_parts, -(-file_bytes(docs) // (BUCKET_MB << 20)))

    def sets_out(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        dealer, seen, count = HotDealer(buckets, base), set(), 0
        for b in it:
            for first in range(0, len(b), 2000):
                part = b.slice(first, 2000)
                ns, names, numbers = [], [], []
                for _, s, edge in sets_of([_plain(t) for t in part.column(1).to_pylist()]):
                    c, n = names_of(s, edge), np.diff(edge)
                    ns.append(n)
                    names.append(c)
                    if len(seen) > 200_000:
                        seen.clear()
                    new = np.zeros(len(c), bool)
                    for i, x in enumerate(c.tolist()):
                        if x not in seen:
                            seen.add(x)
                            new[i] = n[i] > 0
                    number = np.where(new, count + np.cumsum(new) - 1, -1)
                    numbers.append(number)
                    count += int(new.sum())
                    yield from map(_wide, dealer.add(s[np.repeat(new, n)], np.repeat(number[new], n[new]).astype(np.uint32), np.repeat(n[new], n[new]).astype(np.int32)))
                size, number = len(part), np.concatenate(numbers)
                number = pa.array(number + base, pa.int64(), mask=number < 0)
                yield pa.RecordBatch.from_arrays([pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary()), part.column(0).cast(pa.int64()), pa.array(np.concatenate(ns)), pa.array(np.concatenate(names)), number], names=WIDE)
        yield from map(_wide, dealer.flush())

    dealt = docs.mapInArrow(sets_out, DEALT_WIDE)
    key = F.coalesce("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(n_parts)).cast("int"))

    def private_or_shared(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer, at, held = Dealer(buckets, 500_000), None, []

        def finish() -> Iterator[pa.RecordBatch]:
            if held:
                yield from map(_wide, dealer.add(*_shared([np.concatenate(c) for c in zip(*held, strict=True)])))
                held.clear()

        for b in it:
            full = b.column(1).is_valid()
            rest = b.filter(pa.compute.invert(full))
            if len(rest):
                yield rest.select(WIDE)
            for bucket, data in zip(b.filter(full).column(0).to_pylist(), b.filter(full).column(1).to_pylist(), strict=True):
                if bucket != at:
                    yield from finish()
                at = bucket
                held.append(_unpack(loads(data)))
        yield from finish()
        yield from map(_wide, dealer.flush())

    met = dealt.withColumn("k", key).repartition(n_parts, "k").sortWithinPartitions("bucket").select(*WIDE)
    mixed = scratch.write(met.mapInArrow(private_or_shared, DEALT_WIDE))
    if docs is not given:
        scratch.drop(docs)
    documents = scratch.write(mixed.filter("data is null").select("doc_id", "n", "cls"))

    def assemble(arrays: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        number, shingle, rarity, size = arrays
        order = np.lexsort((shingle, rarity, number))
        number, shingle, size = number[order], shingle[order], size[order]
        edge = np.append(np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])), len(number))
        rows = []
        for a, c in zip(edge, edge[1:], strict=False):
            s, n = shingle[a:c], int(size[a])
            private = n - len(s)
            if private > spare(n):
                continue
            rows.append((int(number[a]), n, np.sort(s).tobytes(), s[: spare(n) - private + 1].view(np.int64)))
        for lo in range(0, len(rows), 500):
            part = rows[lo : lo + 500]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())))], names=["number", "n", "shared", "prefix"])

    near = gathered(mixed.filter("data is not null").select("bucket", "data"), n_parts, assemble, "number long, n long, shared binary, prefix array<long>")
    # A class that several tasks dealt has one number of each; one of them stays.
    names = mixed.filter("number is not null").groupBy("cls").agg(F.min("number").alias("number"))
    near = scratch.write(near.join(names, "number").select("cls", "n", "shared", "prefix"))
    scratch.drop(mixed)  # its shingles take more than half as much as the texts
    return documents, near


WIDE = ["bucket", "data", "doc_id", "n", "cls", "number"]
DEALT_WIDE = "bucket int, data binary, doc_id long, n long, cls long, number long"


def _wide(b: pa.RecordBatch) -> pa.RecordBatch:
    none = pa.nulls(len(b), pa.int64())
    return pa.RecordBatch.from_arrays([*b.columns, none, none, none, none], names=WIDE)


class HotDealer(Dealer):
    """Deals (shingle, number, size); a shingle that HOT numbers here have goes by shingle and number, and a marker to its own bucket."""

    def __init__(self, buckets: int, base: int):
        super().__init__(buckets, 1_500_000)
        self.base = base

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        s, c, n = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        order = np.argsort(s, kind="stable")
        t = s[order]
        start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        many = np.diff(np.append(start, len(t)))
        hot = np.empty(len(s), np.uint8)
        hot[order] = np.repeat(many >= HOT, many)
        mark = t[start[many >= HOT]]
        del order, t
        key = s.copy()
        at = np.flatnonzero(hot)
        key[at] = mix(s[at] ^ mix(c[at].astype(np.uint64) + np.uint64(self.base)))
        last = np.full(len(mark), c[-1])
        none = np.zeros(len(mark), np.int32)
        # Numbers ascend, so that they are packed as small differences, however many buckets there are.
        yield from self.packed(np.append(key, mark), [np.append(s, mark), np.append(c, last), np.append(n, none), np.append(hot, none + 2).astype(np.uint8)], self.small)

    def small(self, s: np.ndarray, c: np.ndarray, n: np.ndarray, kind: np.ndarray) -> list[np.ndarray]:
        """The low bytes of the shingles, the first number and the steps from each to the next, sizes and kinds."""
        step = np.diff(c, prepend=c[:1])
        return [s.view(np.uint8).reshape(-1, 8)[:, :WIDTH], np.array([self.base + int(c[0])]), step.astype(np.min_scalar_type(int(step.max()))), n, kind]


def _unpack(arrays: list[np.ndarray]) -> list[np.ndarray]:
    low, first, step, n, kind = arrays
    s = np.zeros((len(low), 8), np.uint8)
    s[:, :WIDTH] = low
    return [s.view(np.uint64).ravel(), first[0] + np.cumsum(step, dtype=np.int64), n, kind]


def _shared(arrays: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Number, shingle, rarity (log2 of the numbers that have it, COMMON if hot) and size of the shared shingles of a bucket."""
    s, c, n, kind = arrays
    order = np.argsort(s, kind="stable")
    s, c, n, kind = s[order], c[order], n[order], kind[order]
    start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    many = np.add.reduceat((kind == 0).astype(np.int64), start)
    rarity = np.where(np.maximum.reduceat(kind, start) > 0, COMMON, np.log2(np.maximum(many, 1)).astype(np.int64)).astype(np.uint8)
    rarity = np.repeat(rarity, np.diff(np.append(start, len(s))))
    keep = (kind < 2) & (rarity > 0)
    return c[keep].view(np.uint64), s[keep], rarity[keep], n[keep]


def _grouped(it: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (key, ...) in order of key, a key's together, without it."""
    at, held = None, []
    for b in it:
        for key, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key != at and held:
                yield held
                held = []
            at = key
            held.append(tuple(row))
    if held:
        yield held


def _pairs(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(2)], names=list(names))


def _forest_of(names: list[int], comps: list[int]) -> Forest:
    forest, first = Forest(len(names)), {}
    for i, c in enumerate(comps):
        forest.join(i, first.setdefault(c, i))
    return forest


def blocks_of(near: DataFrame, scratch: Scratch) -> DataFrame:
    """near with block: the smallest class that pointers between classes of one prefix shingle reach; classes alone are left out."""
    postings = near.select("cls", F.explode("prefix").alias("s"))
    pivot = postings.groupBy("s").agg(F.min("cls").alias("pivot"), F.max("cls").alias("other")).filter("pivot < other").select("s", "pivot")
    pointers = scratch.write(postings.join(pivot, "s").filter("cls <> pivot").select(F.col("cls").alias("a"), F.col("pivot").alias("b")).distinct())
    blocks = components(scratch, pointers).withColumnRenamed("label", "block")
    sized = blocks.join(blocks.groupBy("block").count(), "block")
    return scratch.write(near.join(sized, near["cls"] == sized["id"]).select("block", "count", "cls", "n", "shared"))


def find_components(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, cls) and (cls, component): the classes with links and the smallest class they reach."""
    documents, near = classes(docs, scratch)
    rows = blocks_of(near, scratch)
    scratch.drop(near)

    def label(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _grouped(it):
            held.sort()
            forest = Forest(len(held))
            traverse(SignatureTree([np.frombuffer(r[2], np.uint64) for r in held], np.array([r[1] for r in held], np.int64)), forest)
            yield _pairs([(r[0], held[i][0]) for r, i in zip(held, forest.labels().tolist(), strict=True)], ("cls", "component"))

    done = _shards(rows).mapInArrow(label, "cls long, component long")
    large = rows.filter(F.col("count") > BLOCK)
    if not large.isEmpty():
        done = done.unionByName(large_blocks(scratch, large))
    return documents, scratch.write(done)


def _shards(rows: DataFrame) -> DataFrame:
    """(shard, cls, n, shared) of the blocks that one task takes whole, a shard's together; a block has one shard."""
    small = rows.filter(F.col("count") <= BLOCK)
    shards = max(1, -(-small.count() // BLOCK))
    n_parts = max(partitions(rows.sparkSession), -(-shards // 8))
    return small.select(F.pmod(F.xxhash64("block"), F.lit(shards)).alias("shard"), "cls", "n", "shared").repartition(n_parts, "shard").sortWithinPartitions("shard")


def large_blocks(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """Components of blocks that no task takes whole.

    Pivot rounds: in each block one class of those apart so far is compared with all others apart; what links to it
    is its component. Then classes still apart, or in small components, meet the pieces of the block.
    """
    rows = scratch.write(rows.select("block", "cls", "n", "shared", F.ceil(F.col("count") / BLOCK).cast("long").alias("parts")).withColumn("part", F.pmod(F.xxhash64("cls"), "parts")))
    apart, edges = rows, None
    for r in range(PIVOT_ROUNDS):
        pivots = apart.groupBy("block").agg(F.min_by(F.struct("cls", "n", "shared", "parts"), F.xxhash64("cls", F.lit(r))).alias("p"))
        pivots = pivots.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("p.parts") - 1)))
        pairs = apart.join(pivots, ["block", "part"]).filter(F.col("cls") != F.col("p.cls")).select("cls", "n", "shared", F.col("p.cls").alias("pc"), F.col("p.n").alias("pn"), F.col("p.shared").alias("ps"))
        found = scratch.write(pairs.mapInArrow(_compare, "cls long, pc long"))
        edges = found if edges is None else edges.unionByName(found)
        hit = found.select("cls").union(found.select("pc")).distinct()
        apart = scratch.write(apart.join(hit, "cls", "left_anti").select(*rows.columns))
        if apart.isEmpty():
            break
    so_far = components(scratch, edges.select(F.col("cls").alias("a"), F.col("pc").alias("b")))
    named = rows.join(so_far.withColumnRenamed("id", "cls").withColumnRenamed("label", "comp"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    counts = named.groupBy("block", "comp").count()
    main = counts.groupBy("block").agg(F.max_by("comp", F.struct("count", -F.col("comp"))).alias("main"))
    named = scratch.write(named.join(F.broadcast(main) if main.count() < 100_000 else main, "block").withColumn("minor", F.col("comp") != F.col("main")))
    if named.filter("minor").isEmpty():
        return named.select("cls", F.col("comp").alias("component"))
    edges = edges.unionByName(meet_pieces(scratch, named, False))
    final = components(scratch, edges.select(F.col("cls").alias("a"), F.col("pc").alias("b")))
    return rows.select("cls").join(final.withColumnRenamed("id", "cls"), "cls", "left").select("cls", F.coalesce("label", "cls").alias("component"))


def meet_pieces(scratch: Scratch, named: DataFrame, every: bool) -> DataFrame:
    """Links (cls, pc) of minor classes, from rows (block, cls, n, shared, comp, minor): all of them, or what joins components.

    Pieces hold classes of one band of sizes; only pairs of pieces meet whose sizes allow links.
    """
    band = F.floor(F.log2(F.greatest(F.col("n"), F.lit(1)).cast("double")) / 0.2).cast("long")
    named = named.withColumn("band", band)
    sized = named.groupBy("block", "minor", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("k"))
    dealt = named.join(F.broadcast(sized) if sized.count() < 100_000 else sized, ["block", "minor", "band"])
    dealt = scratch.write(dealt.withColumn("piece", F.concat_ws("/", "minor", "band", F.pmod(F.xxhash64("cls"), "k"))).select("block", "piece", "cls", "n", "shared", "comp", "minor"))
    pieces = dealt.groupBy("block", "piece", "minor").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    other = pieces.select("block", F.col("piece").alias("q"), F.col("minor").alias("minor_q"), F.col("lo").alias("lo_q"), F.col("hi").alias("hi_q"))
    fits = (F.col("hi") * 100 >= F.col("lo_q") * PERCENT) & (F.col("hi_q") * 100 >= F.col("lo") * PERCENT)
    pairs = pieces.filter("minor").join(other, "block").filter(fits & (~F.col("minor_q") | (F.col("piece") <= F.col("q"))))
    pairs = scratch.write(pairs.select("block", F.col("piece").alias("p"), "q"))
    sides = pairs.select("block", F.col("p").alias("piece"), "p", "q").unionByName(pairs.select("block", F.col("q").alias("piece"), "p", "q")).distinct()
    tasks = dealt.join(sides, ["block", "piece"])

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        names, p, q = group["cls"].to_numpy(), group["p"].iloc[0], group["q"].iloc[0]
        forest = None if every else _forest_of(names.tolist(), group["comp"].tolist())
        tree = SignatureTree([np.frombuffer(x, np.uint64) for x in group["shared"]], group["n"].to_numpy())
        left = (group["piece"] == p).to_numpy()
        edges = traverse(tree, forest, group["minor"].to_numpy())
        if every and p != q:  # pairs within a piece are of the task in which it meets itself
            edges = [(a, b) for a, b in edges if left[a] != left[b]]
        return pd.DataFrame({"cls": [int(names[a]) for a, _ in edges], "pc": [int(names[b]) for _, b in edges]}, dtype="int64")

    return scratch.write(tasks.groupBy("block", "p", "q").applyInPandas(meet, "cls long, pc long"))


def _compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        out = []
        for c, n, s, pc, pn, ps in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if linked(overlap(np.frombuffer(s, np.uint64), np.frombuffer(ps, np.uint64)), n, pn):
                out.append((c, pc))
        yield _pairs(out, ("cls", "pc"))


def links(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All links between different texts as pairs (a, b) of classes, and the members (doc_id, n_shingles, cls) of all classes."""
    scratch = Scratch(spark)
    documents, near = classes(docs, scratch)
    rows = blocks_of(near, scratch)
    scratch.keep(documents, rows)

    def pairs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _grouped(it):
            found = traverse(SignatureTree([np.frombuffer(r[2], np.uint64) for r in held], np.array([r[1] for r in held], np.int64)))
            yield _pairs([(held[a][0], held[b][0]) for a, b in found], ("cls", "pc"))

    done = _shards(rows).mapInArrow(pairs, "cls long, pc long")
    large = rows.filter(F.col("count") > BLOCK)
    if not large.isEmpty():
        done = done.unionByName(meet_pieces(scratch, large.select("block", "cls", "n", "shared", F.col("cls").alias("comp"), F.lit(True).alias("minor")), True))
    return done.select(F.least("cls", "pc").alias("a"), F.greatest("cls", "pc").alias("b")), documents.select("doc_id", F.col("n").alias("n_shingles"), "cls")


def join(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each document."""
    scratch = Scratch(spark)
    documents, linked_classes = find_components(docs, scratch)
    scratch.keep(documents, linked_classes)
    # One row for each class of several documents or with links; all joins before the last are of such rows.
    each = documents.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    each = each.join(linked_classes, "cls", "left").filter("rows > 1 or component is not null").withColumn("component", F.coalesce("component", "cls"))
    each = scratch.write(each.select("cls", "rows", "least", "component"))
    least = each.groupBy("component").agg(F.min("least").alias("smallest"))
    named = scratch.write(each.join(least, "component").select("cls", "rows", "smallest"))
    # What else is left here would take disk from the stages that follow.
    scratch.keep(documents, named)
    out = spread_join(documents, named, "cls", "rows", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("smallest", "doc_id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the one with the smallest doc_id. Rows without doc_id stay."""
    member = join(spark, docs).filter("doc_id = component_id or doc_id is null").select("doc_id").distinct()
    return docs.join(member, docs["doc_id"].eqNullSafe(member["doc_id"]), "left_semi")
