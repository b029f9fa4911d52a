"""Removal of repeated passages with suffix arrays built by two-stage sorting.

Every ``size``-byte window is labelled with the smallest hash of its GRAM-byte strings. Equal windows have
equal labels, so windows meet in shards dealt by label, and no window needs to be sent on its own: a run
of windows with one label is one context. Labels that only one text has are dropped first. In each shard
the contexts' suffix array is built in two stages: suffixes smaller than their successor are sorted
directly, to the depth of a window, and the others are induced by one scan of the buckets. Neighbours
with a common prefix of ``size`` bytes are equal windows; those whose smallest doc_id is less than the own
document's are removed.

Exact copies are found by digest first: all but the smallest doc_id of a text lose every byte (texts of at
least ``size`` bytes), and only one text of each kind is searched. Texts are read from one table bucketed
by document, so spans return to them without a second shuffle of texts.

Fixed behaviour: a null text is empty; a row without doc_id is no smaller document and loses nothing; repeated rows
of one doc_id don't remove each other; texts shorter than a window are kept; empty tables give empty results;
further columns, whatever their names, are kept by ``deduplicate`` and ignored by the query.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from .common import DEALT, Dealer, Scratch, file_bytes, gathered, mix, partitions, shared_dir, spread_join

SIZE, GRAM = 50, 20
#: Bytes looked at together.
CHUNK = 1 << 20
#: Shards for each shuffle partition.
SHARDS = 4


def labels(data: np.ndarray, size: int, gram: int) -> np.ndarray:
    """The label of each window of data."""
    h = mix(data.astype(np.uint64) + np.uint64(1))
    length, odd = 1, 0x9E3779B97F4A7C15
    parts: list[tuple[int, np.ndarray]] = [(1, h)]
    while length * 2 <= gram:
        odd = (odd * odd + 2) % (1 << 64)
        h = h[:-length] * np.uint64(odd) + h[length:]
        length *= 2
        parts.append((length, h))
    rest, at, acc = gram, 0, None
    n = len(data) - gram + 1
    for length, h in reversed(parts):
        if length <= rest:
            acc = h[at : at + n].copy() if acc is None else acc * np.uint64(0xC2B2AE3D27D4EB4F) + h[at : at + n]
            at, rest = at + length, rest - length
    low, span, width = mix(acc), 1, size - gram + 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    return low


def runs(texts: list[bytes], size: int = SIZE, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of (bytes, text number, start in the bytes, windows in the run, label) and each text's offset."""
    lo = 0
    while lo < len(texts):
        hi, total = lo, 0
        while hi < len(texts) and (hi == lo or total + len(texts[hi]) <= CHUNK):
            total += len(texts[hi])
            hi += 1
        data = np.frombuffer(b"".join(texts[lo:hi]), np.uint8)
        sizes = np.fromiter(map(len, texts[lo:hi]), np.int64, hi - lo)
        if len(data) >= size:
            label = labels(data, size, gram)
            owner = np.repeat(np.arange(hi - lo), sizes)
            inside = owner[: len(label)] == owner[size - 1 :]
            change = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (owner[1 : len(label)] != owner[: len(label) - 1]) | (inside[1:] != inside[:-1])]))
            count = np.diff(np.append(change, len(label)))
            good = inside[change]
            start, count = change[good], count[good]
            yield data, owner[start] + lo, start, count, label[start], np.cumsum(sizes) - sizes, lo
        lo = hi


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of t (symbols 1 to 256, separators 0, a separator last), as far as depth symbols.

    Stage one sorts the suffixes that are smaller than their successors. Stage two scans the buckets in
    order and appends each suffix's predecessor, if that is larger than its successor, to its own bucket.
    """
    n = len(t)
    signed = t.astype(np.int16)
    step = np.sign(np.diff(signed, append=np.int16(-1)))
    known = np.where(step != 0, np.arange(n), n - 1)
    known = np.minimum.accumulate(known[::-1])[::-1]
    smaller = step[known] > 0
    packed = packed_words(t)

    direct = np.flatnonzero(smaller & (t > 0))
    if len(direct):
        direct = direct[np.argsort(packed[direct], kind="stable")]
        edges = packed[direct][1:] != packed[direct][:-1]
        group = np.concatenate([[0], np.cumsum(edges)])
        for k in range(7, depth + 1, 7):
            count = np.bincount(group)
            open_ = np.flatnonzero(count[group] > 1)
            if not len(open_):
                break
            p = direct[open_]
            key = packed[np.minimum(p + k, n - 1)]
            order = np.lexsort((key, group[open_]))
            direct[open_] = p[order]
            key, g = key[order], group[open_]
            split = np.zeros(len(group), bool)
            split[open_[1:]] = (key[1:] != key[:-1]) & (g[1:] == g[:-1])
            first = np.concatenate([[False], group[1:] != group[:-1]])
            group = np.cumsum(split | first)
    by_symbol = np.searchsorted(t[direct], np.arange(258))
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []
    present = np.flatnonzero(np.bincount(t, minlength=257))
    for c in present:
        if c == 0:
            bucket = np.flatnonzero(t == 0)
        else:
            now = np.concatenate(waiting[c]) if waiting[c] else np.empty(0, np.int64)
            parts = [now]
            while len(now):
                now = now[now > 0] - 1
                now = now[t[now] == c]
                parts.append(now)
            bucket = np.concatenate([*parts, direct[by_symbol[c] : by_symbol[c + 1]]])
        waiting[c] = []
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        symbol = t[before]
        keep = (symbol > c) & ~smaller[before]
        before, symbol = before[keep], symbol[keep]
        order = np.argsort(symbol, kind="stable")
        before, symbol = before[order], symbol[order]
        edge = np.searchsorted(symbol, np.arange(258))
        for s in np.flatnonzero(np.diff(edge)):
            waiting[s].append(before[edge[s] : edge[s + 1]])
    return np.concatenate(out)


def packed_words(t: np.ndarray) -> np.ndarray:
    """Seven 9-bit symbols from each position as one number, so that words sort as their symbols."""
    n = len(t)
    out = np.zeros(n, np.uint64)
    for j in range(7):
        out <<= np.uint64(9)
        out[: n - j] |= t[j:].astype(np.uint64)
    return out


def common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order, up to most symbols; the first has 0.

    Two separators at one place count as equal symbols, so only windows that hold none have exact values.
    """
    n, packed = len(t), packed_words(t)
    out = np.zeros(len(sa), np.int64)
    open_ = np.arange(1, len(sa))
    for k in range(0, most - 6, 7):
        a, b = np.minimum(sa[open_ - 1] + k, n - 1), np.minimum(sa[open_] + k, n - 1)
        same = packed[a] == packed[b]
        open_ = open_[same]
        out[open_] = k + 7
    left = np.arange(1, len(sa))
    for _ in range(7):
        at = out[left]
        a, b = sa[left - 1] + at, sa[left] + at
        ok = (at < most) & (np.maximum(a, b) < n)
        left, a, b = left[ok], a[ok], b[ok]
        left = left[(t[a] == t[b]) & (t[a] > 0)]
        out[left] += 1
    return out


def smallest_owner(contexts: np.ndarray, lengths: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    """For each window of each context, in order, the smallest owner of an equal window in any of them."""
    ends = np.cumsum(lengths)
    t = np.zeros(int(ends[-1]) + len(lengths), np.uint16)
    which = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(contexts)) + which
    t[place] = contexts.astype(np.uint16) + 1
    is_window = np.zeros(len(t), bool)
    windows = lengths - size + 1
    first = np.repeat(ends - lengths + np.arange(len(lengths)), windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    is_window[first] = True
    sa = suffix_array(t, size)
    sa = sa[is_window[sa]]
    group = np.cumsum(common_prefixes(t, sa, size) < size) - 1
    number = np.full(len(t), -1)
    number[first] = np.arange(len(first))
    whose = np.repeat(owner, windows)
    smallest = np.full(group[-1] + 1, np.iinfo(np.int64).max)
    at = number[sa]
    np.minimum.at(smallest, group, whose[at])
    out = np.empty(len(first), np.int64)
    out[at] = smallest[group]
    return out


def union(spans: np.ndarray) -> np.ndarray:
    """Sorted disjoint [start, end) rows covering the same bytes."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    far = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > far[:-1]])
    return np.stack([spans[new, 0], far[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)]], axis=1)


def find_spans(spark: SparkSession, scratch: Scratch, table: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """doc_id, th and spans (packed [start, end) pairs) of the texts of table (doc_id, th, text) that lose bytes."""
    n = partitions(spark, table, 64)
    shards = max(SHARDS * n, -(-file_bytes(table) // (4 << 20)))

    def label_out(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(n)
        for b in it:
            th = b.column(0).to_numpy()
            texts = [x.encode("utf-8", "surrogatepass") for x in b.column(1).to_pylist()]
            for _, who, _, _, label, _, _ in runs(texts, size, gram):
                order = np.lexsort((label, who))
                who, label = who[order], label[order]
                new = np.concatenate([[True], (who[1:] != who[:-1]) | (label[1:] != label[:-1])])[: len(who)]
                yield from dealer.add(label[new], th[who[new]])
        yield from dealer.flush()

    def shared_labels(arrays: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        label, th = arrays
        order = np.argsort(label, kind="stable")
        label, th = label[order], th[order]
        same = label[1:] == label[:-1]
        twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        yield from _once(Dealer(n), th[twice].view(np.uint64), label[twice])

    def by_document(arrays: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        th, label = arrays
        order = np.argsort(th, kind="stable")
        th, label = th[order], label[order]
        edge = np.append(np.flatnonzero(np.concatenate([[True], th[1:] != th[:-1]])), len(th))
        for lo in range(0, len(edge) - 1, 2000):
            own = edge[lo : lo + 2001]
            yield pa.RecordBatch.from_arrays([pa.array(th[own[:-1]].view(np.int64)), pa.array([label[a:c].tobytes() for a, c in zip(own, own[1:], strict=False)], pa.binary())], names=["th", "shared"])

    found = gathered(table.select("th", "text").mapInArrow(label_out, DEALT), n, shared_labels, DEALT)
    shared = gathered(found, n, by_document, "th long, shared binary")
    shared = scratch.write(shared)
    with_labels = table.join(shared, "th").select("doc_id", "th", "text", "shared")

    def contexts_out(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = [[] for _ in range(6)]
        total = 0
        for b in it:
            ids, th = b.column(0).to_numpy(), b.column(1).to_numpy()
            texts = [x.encode("utf-8", "surrogatepass") for x in b.column(2).to_pylist()]
            shared = [np.frombuffer(x, np.uint64) for x in b.column(3).to_pylist()]
            for data, who, start, count, label, offset, lo in runs(texts, size, gram):
                edge = np.searchsorted(who, np.arange(lo, who[-1] + 2)) if len(who) else np.zeros(1, int)
                keep = np.zeros(len(who), bool)
                for k in range(len(edge) - 1):
                    a, c = edge[k], edge[k + 1]
                    if c > a:
                        keep[a:c] = np.isin(label[a:c], shared[lo + k])
                who, start, count, label = who[keep], start[keep], count[keep], label[keep]
                raw = data.tobytes()
                held[0].append(label)
                held[1] += [raw[s:e] for s, e in zip(start.tolist(), (start + count + size - 1).tolist(), strict=True)]
                held[2].append(ids[who])
                held[3].append(th[who])
                held[4].append(start - offset[who - lo])
                total += len(who)
            if total > 1_000_000:
                yield from deal_contexts(held, shards)
                held, total = [[] for _ in range(6)], 0
        if total:
            yield from deal_contexts(held, shards)

    def match(arrays: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        raw, length, ids, th, at = arrays
        data, ends = raw.tobytes(), np.cumsum(length)
        number: dict[bytes, int] = {}
        which = np.fromiter((number.setdefault(data[e - x : e], len(number)) for e, x in zip(ends.tolist(), length.tolist(), strict=True)), np.int64, len(length))
        owner = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(owner, which, ids)
        lengths = np.fromiter(map(len, number), np.int64, len(number))
        smallest = smallest_owner(np.frombuffer(b"".join(number), np.uint8), lengths, owner, size)
        windows = lengths - size + 1
        first = np.cumsum(windows) - windows
        w = windows[which]
        inst = np.repeat(np.arange(len(which)), w)
        k = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        hit = smallest[first[which][inst] + k] < ids[inst]
        edge = np.flatnonzero(np.concatenate([[True], (hit[1:] != hit[:-1]) | (inst[1:] != inst[:-1])]))
        last = np.append(edge[1:], len(hit)) - 1
        edge, last = edge[hit[edge]], last[hit[edge]]
        i = inst[edge]
        yield from _once(Dealer(n), th[i].view(np.uint64), ids[i], at[i] + k[edge], at[i] + k[last] + size)

    def merge(arrays: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        th, ids, a, c = arrays
        order = np.lexsort((a, ids, th))
        th, ids, a, c = th[order], ids[order], a[order], c[order]
        edge = np.append(np.flatnonzero(np.concatenate([[True], (th[1:] != th[:-1]) | (ids[1:] != ids[:-1])])), len(th))
        spans = [union(np.stack([a[x:y], c[x:y]], axis=1)).astype(np.int64).tobytes() for x, y in zip(edge, edge[1:], strict=False)]
        first = edge[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(ids[first]), pa.array(th[first].view(np.int64)), pa.array(spans, pa.binary())], names=["doc_id", "th", "spans"])

    dealt = with_labels.mapInArrow(contexts_out, DEALT)
    spans = gathered(gathered(dealt, n, match, DEALT), n, merge, "doc_id long, th long, spans binary")
    return scratch.write(spans)


def _once(dealer: Dealer, *arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(arrays[0]):
        yield from dealer.add(*arrays)
        yield from dealer.flush()


def deal_contexts(held: list, shards: int) -> Iterator[pa.RecordBatch]:
    """Contexts go to the shard of their label."""
    from .common import dumps

    label = np.concatenate(held[0])
    texts, (ids, th, at) = held[1], (np.concatenate(x) for x in held[2:5])
    bucket = (label % np.uint64(shards)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[order], np.arange(shards + 1))
    for k in np.flatnonzero(np.diff(edge)):
        own = order[edge[k] : edge[k + 1]]
        mine = [texts[i] for i in own.tolist()]
        data = dumps(np.frombuffer(b"".join(mine), np.uint8), np.fromiter(map(len, mine), np.int64, len(mine)), ids[own], th[own], at[own])
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([data], pa.binary())], names=["bucket", "data"])


def deduplicate(spark: SparkSession, docs: DataFrame, digest: bool = False, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """docs with each text's repeated bytes removed (broken UTF-8 at a seam is dropped), or the digest columns."""
    scratch = Scratch(spark)
    n = partitions(spark, docs, 64)
    given = [] if digest else [c for c in docs.columns if c not in ("doc_id", "text")]
    # Further columns lie in one struct, so that no name of theirs meets one of ours.
    rest = F.struct(*(docs[c] for c in given)) if given else F.lit(None).cast("struct<none: int>")
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), rest.alias("rest")).withColumn("th", F.xxhash64("text"))
    name = f"probecraft_{uuid.uuid4().hex}"
    keyed.repartition(n, "doc_id", "th").write.option("compression", "zstd").option("path", f"{shared_dir(spark)}/probecraft/{name}").bucketBy(n, "doc_id", "th").saveAsTable(name)
    table = spark.table(name)
    small = scratch.write(table.select("doc_id", "th", F.sha2("text", 256).alias("sha")).filter("doc_id is not null").distinct())
    firsts = small.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("held"))
    marks = scratch.write(spread_join(small, firsts, "sha", "held").select("doc_id", "th", (F.col("doc_id") > F.col("first")).alias("copy")))
    first_texts = table.join(marks.filter("not copy"), ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]).filter(F.octet_length("text") >= size)
    spans = find_spans(spark, scratch, first_texts.select("doc_id", "th", "text"), size, gram)
    notes = marks.join(spans, ["doc_id", "th"], "left").filter("copy or spans is not null")
    joined = table.join(notes, ["doc_id", "th"], "left").select("copy", "spans", "doc_id", "text", "rest")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for copy, spans, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                if copy:
                    cut = np.array([[0, len(data)]] if len(data) >= size else [], np.int64).reshape(-1, 2)
                else:
                    cut = np.frombuffer(spans or b"", np.int64).reshape(-1, 2)
                last, kept = 0, []
                for a, c in cut.tolist():
                    kept.append(data[last:a])
                    last = c
                kept = b"".join([*kept, data[last:]])
                rows.append((len(data), int((cut[:, 1] - cut[:, 0]).sum()), len(cut), hashlib.sha256(kept).hexdigest()) if digest else kept.decode("utf-8", "ignore"))
            if digest:
                new = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([b.column(2), *new], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([b.column(2), pa.array(rows, pa.string()), b.column(4)], names=["doc_id", "text", "rest"])

    if digest:
        return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    schema = StructType([StructField(c, joined.schema[c].dataType) for c in ("doc_id", "text", "rest")])
    out = joined.mapInArrow(run, schema)
    return out.select(*(F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages; documents of which nothing is left go."""
    return deduplicate(spark, docs).filter("text is not null and text <> ''")
