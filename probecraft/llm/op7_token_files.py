"""Token ids in Simple-8b word-aligned files.

A 64-bit word has a 4-bit selector and 60 bits of payload: selector s packs COUNTS[s] ids of WIDTHS[s]
bits. An id too wide for 60 bits cannot occur (ids are unsigned 32-bit); selector 15 is the escape that
holds one whole 32-bit id. The rows of the table are blocks of whole documents in ascending doc_id
order, each a self-contained binary:

    magic PCS8, version, number of documents n, number of words w, number of ids t   (5 x u32)
    n + 1 document offsets in ids (u64)     ceil(w / 1024) + 1 id offsets of word groups (u64)
    w words (u64)

The group offsets let a reader start at any group of 1,024 words. Blocks are written as Parquet rows, so
that the commit protocol of the writer covers lost executors and any store Spark can reach.

Fixed behaviour: a null text encodes as an empty one and holds just the end id; ties of doc_id go by text;
repeated rows are each encoded; a block ends after BLOCK_IDS ids, but never within a document; empty
tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import zlib
import json
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Scratch, partitions

#: Fixed values of the format.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 32)
ESCAPE = 15
MAGIC = int.from_bytes(b"PCS8", "little")
GROUP = 1024
#: Documents encoded together.
END_ID, BLOCK_IDS, SLICE = 2, 1 << 20, 8192
#: Separators that Python strings count as white space differently from patterns.
WHITE = "\x1c\x1d\x1e\x1f\x85"
#: The pre-tokeniser's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def widths_of(ids: np.ndarray) -> np.ndarray:
    """Bits of each id, one at least."""
    return np.frexp(ids.astype(np.float64))[1].clip(1).astype(np.uint8) if len(ids) and ids.max() > 0xFFFF else BITS[ids]


BITS = np.frexp(np.arange(1 << 16).astype(np.float64))[1].clip(1).astype(np.uint8)


def pack(ids: np.ndarray) -> np.ndarray:
    """Simple-8b words. A word takes as many ids as the narrowest fitting selector allows.

    Running maxima of the widths over each selector's count say which selectors fit where, for all
    positions at once; the walk over word starts then only follows those lengths.
    """
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64)
    bits = widths_of(ids)
    choice = np.full(n, ESCAPE, np.uint8)
    length = np.ones(n, np.uint8)
    most, span = bits, 1
    for s in range(len(COUNTS) - 1, -1, -1):
        count, width = COUNTS[s], WIDTHS[s]
        if count > n or width > 30:
            continue
        if count > span:  # two overlapping or touching runs of span cover count, as counts at most double
            most, span = np.maximum(most[: n - count + 1], most[count - span : n - span + 1]), count
        fits = most <= width
        if not fits.any():
            break
        np.copyto(choice[: n - count + 1], np.uint8(s), where=fits)
        np.copyto(length[: n - count + 1], np.uint8(count), where=fits)
    steps = length.tobytes()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += steps[at]
    starts = np.array(starts)
    chosen = choice[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        own = np.flatnonzero(chosen == s)
        count, width = (1, 32) if s == ESCAPE else (COUNTS[s], WIDTHS[s])
        first, built = starts[own], words[own]
        for k in range(count):
            built |= ids[first + k].astype(np.uint64) << np.uint64(k * width)
        words[own] = built
    return words


def unpack(words: np.ndarray) -> np.ndarray:
    """All ids of Simple-8b words, selector by selector."""
    if not len(words):
        return np.empty(0, np.uint32)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    length = np.array([*COUNTS, 1, 1])[chosen]
    start = np.cumsum(length) - length
    out = np.empty(int(length.sum()), np.uint32)
    for s in np.unique(chosen):
        own = np.flatnonzero(chosen == s)
        count, width = (1, 32) if s == ESCAPE else (COUNTS[s], WIDTHS[s])
        mask = np.uint64((1 << width) - 1)
        for k in range(count):
            out[start[own] + k] = ((words[own] >> np.uint64(k * width)) & mask).astype(np.uint32)
    return out


def write_block(documents: list[np.ndarray]) -> bytes:
    offsets = np.cumsum([0, *map(len, documents)]).astype("<u8")
    ids = np.concatenate(documents) if documents else np.empty(0, np.uint32)
    words = pack(ids)
    length = np.array([*COUNTS, 1, 1])[(words >> np.uint64(60)).astype(np.int64)]
    ends = np.concatenate([[0], np.cumsum(length)])
    groups = np.concatenate([ends[:-1][::GROUP], ends[-1:]]).astype("<u8")
    head = np.array([MAGIC, 1, len(documents), len(words), len(ids)], "<u4")
    return b"".join(x.tobytes() for x in (head, offsets, groups, words.astype("<u8")))


def read_block(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Document offsets and ids of a block."""
    magic, version, n, w, t = np.frombuffer(data, "<u4", 5).tolist()
    if (magic, version) != (MAGIC, 1):
        raise ValueError("not a token block")
    offsets = np.frombuffer(data, "<u8", n + 1, 20)
    n_groups = -(-w // GROUP) + 1
    words = np.frombuffer(data, "<u8", w, 20 + 8 * (n + 1 + n_groups))
    ids = unpack(words)
    if len(ids) != t:
        raise ValueError("a token block is damaged")
    return offsets, ids


def read_group(data: bytes, group: int) -> tuple[int, np.ndarray]:
    """One group of words: the index of its first id, and its ids."""
    _, _, n, w, _ = np.frombuffer(data, "<u4", 5).tolist()
    at = 20 + 8 * (n + 1)
    n_groups = -(-w // GROUP) + 1
    first = np.frombuffer(data, "<u8", n_groups, at)
    lo = group * GROUP
    words = np.frombuffer(data, "<u8", min(GROUP, w - lo), at + 8 * (n_groups + lo))
    return int(first[group]), unpack(words)


def check_merges(path: str) -> None:
    """Raise unless the file merges pairs in the order of the ids they make, each id from one pair, which is how ranks merge."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(a >= b for a, b in pairwise(made)):
        raise ValueError(f"{path} does not merge in order of ids")


class Encoder:
    """Ids of whole texts, equal to those of the tokenizers library for the same file.

    The pattern starts a new pre-token at every single space, so runs between spaces encode alone, each
    with the space before it, and each distinct run of a batch is merged once. Merging goes through
    tiktoken with the vocabulary of the tokenizer file, about six times as fast as the tokenizers library
    on short strings. Only where a space is followed by white space or the end does a pre-token span
    runs: a text with such an ``odd`` run, or with a special token's string, goes to the tokenizers
    library whole.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        from .op6_bpe import byte_letters

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        back = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(back[c] for c in t): i for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items() if i not in added}
        check_merges(path)
        self.merge = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def many(self, texts: pa.Array) -> list[np.ndarray]:
        if not len(texts):
            return []
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        runs = pc.split_pattern(texts, " ")
        edge = runs.offsets.to_numpy()
        values = runs.values.slice(edge[0], edge[-1] - edge[0])
        edge = (edge - edge[0])[:-1]
        coded = values.dictionary_encode()
        tails = coded.dictionary.to_pylist()
        odd = np.array([not x or x[0] in WHITE or x[0].isspace() for x in tails] + [False] * len(texts))
        ids = [self.merge(" " + x) for x in tails]
        heads = values.take(pa.array(edge)).to_pylist()
        ids += [self.merge(x) for x in heads]
        size_of = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(size_of.sum()))
        first = np.cumsum(size_of) - size_of
        n = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n[edge] = len(tails) + np.arange(len(texts))
        size = size_of[n]
        end = np.cumsum(size)
        out = flat[np.repeat(first[n] - end + size, size) + np.arange(end[-1])]
        ends = np.append(end[edge[1:] - 1], end[-1])
        docs = np.split(out, ends[:-1])
        special = np.zeros(len(texts), bool)
        for s in self.special:
            special |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(special | np.logical_or.reduceat(odd[n], edge)):
            docs[i] = self.whole(texts[int(i)].as_py())
        return docs

    def __call__(self, text: str | None) -> np.ndarray:
        return self.many(pa.array([text], pa.string()))[0]


def write(spark: SparkSession, docs: DataFrame, scratch: Scratch, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """The written blocks: part, block, doc_ids, data."""
    path = path or vocabulary_path()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block = TaskContext.get().partitionId(), 0
        encode, own, ids, size = Encoder(path), [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal own, ids, size, block
            data = write_block(ids)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([size], pa.int64()), pa.array([own], pa.list_(pa.int64())), pa.array([data], pa.binary())], names=["part", "block", "n_ids", "doc_ids", "data"])
            own, ids, size, block = [], [], 0, block + 1
            return out

        for b in it:
            for lo in range(0, len(b), SLICE):
                part_of = b.slice(lo, SLICE)
                for doc, coded in zip(part_of.column(0).to_pylist(), encode.many(part_of.column(1)), strict=True):
                    got = np.append(coded, np.uint32(end_id))
                    own.append(doc)
                    ids.append(got)
                    size += len(got)
                    if size >= BLOCK_IDS:
                        yield flush()
        if own:
            yield flush()

    ordered = docs.select("doc_id", "text").repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return scratch.write(ordered.mapInArrow(run, "part int, block int, n_ids long, doc_ids array<long>, data binary"))


def read(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of the documents in written blocks.

    Blocks before a block are summed over (part, block, n_ids): one small row for about a million ids.
    """
    sizes = blocks.select("part", "block", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    within = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = sizes.withColumn("within", within).join(parts, "part").select("part", "block", (F.col("before") + F.col("within")).alias("before"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for part, block, doc_ids, data in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                offsets, ids = read_block(data)
                raw, edges = ids.astype("<u4").tobytes(), offsets.tolist()
                crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(edges, edges[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(crc), pa.int32()), pa.array([block] * len(crc), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(edges[:-1], pa.int64()), pa.array(np.diff(offsets.astype(np.int64)), pa.int64()), pa.array(crc, pa.int64())],
                    names=["part", "block", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    rows = blocks.select("part", "block", "doc_ids", "data").mapInArrow(run, "part int, block int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(at, ["part", "block"]).select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    return read(write(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch))
