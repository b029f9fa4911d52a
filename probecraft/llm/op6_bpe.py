"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The frequent words of the corpus are encoded once on the driver and compiled into a shared-suffix
automaton whose edge outputs add up to the word's number; that number points into a table of ids.
Executors memory-map the file. Words outside it are merged exactly, pair by lowest rank.

Fixed behaviour: a null text encodes as an empty one, to no ids and an empty decoding; a special
token's string within a text becomes its id; empty tables give empty results; repeated rows are
encoded alike; very long texts are encoded whole; further columns are kept by ``encode_documents``.
"""

from __future__ import annotations

import atexit
import functools
import gc
import hashlib
import json
import mmap
import os
import re
import shutil
import struct
import tempfile
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, zip_longest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Scratch

#: Words in the lexicon, and words that a task remembers in each of two generations.
LEXICON_WORDS, MEMO_WORDS = 100_000, 200_000
#: Ids of a batch, beyond which their strings are joined without Arrow.
ARROW_IDS = 20_000_000
#: The word pattern of the vocabulary file.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MAGIC = b"PCLEX002"


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable stand-in for each byte: itself if visible in Latin-1, else the next letter from U+0100."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    out = [""] * 256
    for b in visible:
        out[b] = chr(b)
    for i, b in enumerate(hidden):
        out[b] = chr(256 + i)
    return out


def ranges(points: Iterable[int]) -> str:
    """Ascending code points as the inside of a character class."""
    out: list[list[int]] = []
    for c in points:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


class Vocabulary:
    """Word BPE with an end-of-word suffix, read from a tokenizer file.

    Texts with letters that Python's Unicode tables lack or treat differently (``odd``, a character class found by asking the
    tokenizers library about every code point) are put in normal form and cut into words by that library.
    """

    def __init__(self, path: str, odd: str | None = None):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.letters = byte_letters()
        self.find = regex.compile(WORD).findall
        library = Tokenizer.from_file(path)
        self.library_normal, self.library_split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.bytes_of = {c: b for b, c in enumerate(self.letters)}
        self.odd = self.odd_letters() if odd is None else odd
        self.odd_at, self.maybe_odd = re.compile(f"[{self.odd}]").search, re.compile("[\u0378-\U0010ffff]").search
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def odd_letters(self) -> str:
        """Code points that Python has not assigned, or that the library puts in another normal form or cuts otherwise.

        Normal forms of sequences of assigned code points are the same in all versions of Unicode.
        """
        known = [c for c in map(chr, chain(range(2, 0xD800), range(0xE000, 0x110000))) if unicodedata.category(c) not in ("Cn", "Co")]
        forms = self.library_normal("\x01".join(known)).split("\x01")
        space = re.compile(r"\s")
        odd = {c for c, f in zip(known, forms, strict=True) if self.normal(c) != f and not (f == " " and space.match(c))}
        same = [c for c in known if c not in odd]
        # Between two letters a letter joins, a digit stands alone, a space cuts.
        ours = iter(self.find("\n".join(f"a{self.normal(c)}a" for c in same)))
        theirs = self.library_split("\n".join(f"a{self.normal(c)}a" for c in same))
        pieces = iter([self.plain(t) for t, _ in theirs])
        if any(a != b for a, b in zip_longest(ours, pieces)):
            split = lambda c: [self.plain(t) for t, _ in self.library_split(f"a{self.normal(c)}a")]
            odd |= {c for c in same if self.find(f"a{self.normal(c)}a") != split(c)}
        lacking = (c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn")
        return ranges(sorted({*lacking, *map(ord, odd)}))

    def plain(self, piece: str) -> str:
        """The word of a piece in stand-ins for bytes."""
        return bytes(map(self.bytes_of.__getitem__, piece)).decode()

    def is_odd(self, text: str) -> bool:
        return not text.isascii() and self.maybe_odd(text) is not None and self.odd_at(text) is not None

    def normal(self, text: str) -> str:
        """NFC and lower case, letter by letter."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def split(self, text: str) -> list[str]:
        """Words of a text without special tokens."""
        if self.is_odd(text):
            return [self.plain(t) for t, _ in self.library_split(self.library_normal(text))]
        return self.find(self.normal(text))

    def spaced(self, text: str) -> str | None:
        """The normal text, whose runs between spaces share no word; None if it has special tokens or odd letters."""
        return None if "<|" in text or self.is_odd(text) else self.normal(text).replace("\n", " ")

    def words(self, run: str) -> list[str]:
        """Words of a run."""
        return [run] if run.isascii() and run.isalpha() else self.find(run)

    def pieces(self, text: str) -> list[str]:
        """Words and special tokens of a text, in order."""
        if self.cut is None or "<|" not in text:
            return self.split(text)
        out = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(part)
            elif part:
                out += self.split(part)
        return out

    def merge(self, word: str) -> list[int]:
        """Exact merges of one word: the adjacent pair of lowest rank first, leftmost among equals."""
        if word in self.special:
            return [self.special[word]]
        symbols = [self.letters[b] for b in word.encode("utf-8", "replace")]
        if not symbols:
            return []
        symbols[-1] += self.suffix
        if len(symbols) > 200:
            return self._merge_long(symbols)
        get, none = self.ranks.get, 1 << 60
        ranks = [get(p, none) for p in zip(symbols, symbols[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = get((symbols[at - 1], symbols[at]), none)
            if at < len(ranks):
                ranks[at] = get((symbols[at], symbols[at + 1]), none)
        return [self.ids[s] for s in symbols if s in self.ids]

    def _merge_long(self, symbols: list[str]) -> list[int]:
        """The same merges with a heap over a linked list, for words of any length."""
        import heapq

        n, ranks = len(symbols), self.ranks
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = [(ranks[p], i, *p) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], alive[j], after[i] = a + b, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (p := (symbols[k], symbols[after[k]])) in ranks:
                    heapq.heappush(heap, (ranks[p], k, *p))
        return [self.ids[s] for i, s in enumerate(symbols) if alive[i] and s in self.ids]


def build_lexicon(words: Iterable[bytes], outputs: dict[bytes, list[int]], path: str) -> None:
    """Write the minimal acyclic transducer of sorted distinct words to a file.

    States are registered from the last one backwards, so equal suffixes share them; each state knows
    how many words it accepts, and an edge's output is the number of words that sort before it.
    """
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((byte, target, output), ...), words below)

    def freeze(node: list) -> int:
        seen, edges = int(node[0]), []
        for byte, target in node[1]:
            edges.append((byte, target, seen))
            seen += states[target][2]
        key = (node[0], tuple(edges))
        if key not in register:
            register[key] = len(states)
            states.append((*key, seen))
        return register[key]

    stack: list[list] = [[False, []]]
    letters: list[int] = []
    previous = b""
    words = list(words)
    for word in words:
        common = len(os.path.commonprefix([word, previous]))
        while len(letters) > common:
            done = freeze(stack.pop())
            stack[-1][1].append((letters.pop(), done))
        for byte in word[common:]:
            letters.append(byte)
            stack.append([False, []])
        stack[-1][0] = True
        previous = word
    while letters:
        done = freeze(stack.pop())
        stack[-1][1].append((letters.pop(), done))
    root = freeze(stack.pop())
    flat = [(n << 8 | e[0], e[1], e[2]) for n, s in enumerate(states) for e in s[1]]
    columns = [
        np.array([s[0] for s in states], np.uint8),
        np.array([e[0] for e in flat], "<u8"),
        np.array([e[1] for e in flat], "<u4"),
        np.array([e[2] for e in flat], "<u4"),
        np.cumsum([0, *(len(outputs[w]) for w in words)]).astype("<u4"),
        np.array([i for w in words for i in outputs[w]], "<u4"),
    ]
    with open(path, "wb") as f:
        f.write(MAGIC + struct.pack("<Q", root) + struct.pack("<6Q", *map(len, columns)))
        for c in columns:
            f.write(c.tobytes() + bytes(-c.nbytes % 8))


class Lexicon:
    """A memory-mapped lexicon file: bytes of a word to its ids, or None."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        if self.data[:8] != MAGIC:
            raise ValueError(f"{path} is not a lexicon")
        self.root = struct.unpack_from("<Q", self.data, 8)[0]
        sizes, at = struct.unpack_from("<6Q", self.data, 16), 16 + 48
        views = []
        for n, kind in zip(sizes, ("u1", "<u8", "<u4", "<u4", "<u4", "<u4"), strict=True):
            views.append(np.frombuffer(self.data, kind, n, at))
            at += views[-1].nbytes + -views[-1].nbytes % 8
        self.final, self.edge, self.target, self.output, self.start, self.ids = views

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 where it is not in the lexicon; all words take their next byte at a time."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        at = np.cumsum(size) - size
        letters = np.frombuffer(b"".join(words), np.uint8)
        out = np.full(len(words), -1, np.int64)
        live = np.arange(len(words))
        state, number, depth = np.full(len(words), self.root, np.uint64), np.zeros(len(words), np.int64), 0
        while len(live):
            done = size[live] == depth
            ended = done & (self.final[state] == 1)
            out[live[ended]] = number[ended]
            live, state, number = live[~done], state[~done], number[~done]
            if not len(live) or not len(self.edge):
                break
            key = state << np.uint64(8) | letters[at[live] + depth]
            edge = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            found = self.edge[edge] == key
            live, edge = live[found], edge[found]
            state, number = self.target[edge].astype(np.uint64), number[found] + self.output[edge]
            depth += 1
        return out

    def many(self, words: list[bytes]) -> list[list[int] | None]:
        ids, start = self.ids, self.start
        return [None if n < 0 else ids[start[n] : start[n + 1]].tolist() for n in self.numbers(words).tolist()]

    def get(self, word: bytes) -> list[int] | None:
        return self.many([word])[0]


class Merger:
    """Exact merges of many words at once by tiktoken.

    That library ranks a pair by the token it makes, whatever its parts. A token whose own making takes only
    pairs of the merge list, at their ranks, is made alike in every word; words with any other token (``odd``), and
    long ones, are merged one by one. A line feed, which no word holds, ends words in place of the suffix.
    """

    def __init__(self, vocabulary: Vocabulary, odd: Iterable[int] | None = None):
        import tiktoken

        back = {c: bytes([b]) for b, c in enumerate(vocabulary.letters)}
        whole = lambda t: b"".join(map(back.__getitem__, t.removesuffix(vocabulary.suffix))) + b"\n" * t.endswith(vocabulary.suffix)
        ids, letters = vocabulary.ids, vocabulary.letters
        ranks = {bytes([b]): b for b in range(256)} | {bytes([b, 10]): 256 + b for b in range(256)}
        to_id = [ids.get(c, -1) for c in letters] + [ids.get(c + vocabulary.suffix, -1) for c in letters]
        self.pairs = {}
        for (a, b), i in vocabulary.ranks.items():
            self.pairs[whole(a), whole(b)] = 512 + i
            ranks.setdefault(whole(a) + whole(b), 512 + i)
            to_id.append(ids.get(a + b, -1))
        self.vocabulary, self.ranks, self.to_id = vocabulary, ranks, np.array(to_id)
        self.odd = self.unlike() if odd is None else list(odd)
        self.is_odd = np.zeros(len(to_id), bool)
        self.is_odd[self.odd] = True
        self.is_odd |= self.to_id < 0
        self.is_end = np.zeros(len(to_id), bool)
        self.is_end[[r for t, r in ranks.items() if t[-1] == 10]] = True
        self.encode = tiktoken.Encoding("words", pat_str=r"[^\n]+\n", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def unlike(self) -> list[int]:
        """Ranks of the tokens whose making takes a pair outside the merge list."""
        ranks, pairs, out = self.ranks, self.pairs, []
        for token, rank in ranks.items():
            if rank < 512:
                continue
            parts = [token[i : i + 1] for i in range(len(token))]
            if parts[-1] == b"\n":
                parts[-2:] = [parts[-2] + b"\n"]
            while len(parts) > 1:
                best, i = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if pairs.get((parts[i], parts[i + 1])) != best:
                    out.append(rank)
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return out

    def many(self, words: list[str]) -> list[list[int]]:
        """Ids of each word; words are neither empty nor special tokens and hold no line feed."""
        slow = self.vocabulary.merge
        short = [w for w in words if len(w) <= 200]
        if not short:
            return [slow(w) for w in words]
        got = np.array(self.encode("\n".join(short) + "\n"))
        edge = np.flatnonzero(self.is_end[got]) + 1
        odd = np.logical_or.reduceat(self.is_odd[got], np.concatenate([[0], edge[:-1]])).tolist()
        ids, edge = self.to_id[got].tolist(), [0, *edge.tolist()]
        fast = iter([slow(w) if o else ids[a:b] for w, o, a, b in zip(short, odd, edge[:-1], edge[1:], strict=True)])
        return [next(fast) if len(w) <= 200 else slow(w) for w in words]


@functools.cache
def vocabulary_of(path: str, odd: str | None = None) -> Vocabulary:
    return Vocabulary(path, odd)


def chunks(texts: pa.Array, limit: int = 1 << 22) -> Iterator[list[str | None]]:
    """Whole texts, in order, in lists of about limit characters."""
    held, size = [], 0
    for t in texts:
        held.append(t.as_py())
        size += len(held[-1] or "")
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def indexed_runs(vocabulary: Vocabulary, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, list[int]]:
    """Distinct runs of the texts, the run at each place, the first place of each text (and the end), and the texts that have no runs."""
    spaced = [vocabulary.spaced(t or "") for t in texts]
    runs = pc.split_pattern(pa.array([s or "" for s in spaced], pa.large_string()), " ")
    coded = runs.values.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), runs.offsets.to_numpy(), [i for i, s in enumerate(spaced) if s is None]


def frequent_words(texts: DataFrame, path: str, odd: str, scratch: Scratch, limit: int = LEXICON_WORDS) -> list[str]:
    """The words with the highest counts over all texts: as many whole steps of counts as have no more than limit words.

    A histogram of the counts finds the least count, so that only these words come to the driver.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, runs = vocabulary_of(path, odd), Counter()

        def flush() -> pa.RecordBatch:
            counts: Counter = Counter()
            for run, n in runs.items():
                for w in vocabulary.words(run):
                    counts[w] += n
            runs.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["w", "n"])

        for b in it:
            for texts in chunks(b.column(0)):
                distinct, place, _, apart = indexed_runs(vocabulary, texts)
                for r, n in zip(distinct, np.bincount(place, minlength=len(distinct)).tolist(), strict=True):
                    runs[r] += n
                for i in apart:
                    runs.update(vocabulary.split(texts[i]))
                if len(runs) > MEMO_WORDS:
                    yield flush()
        yield flush()

    step = F.floor(F.log2(F.col("n").cast("double")) * 16).alias("step")
    counted = scratch.write(texts.select("text").mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).filter("n > 1").withColumn("step", step))
    least, total = None, 0
    for r in sorted(counted.groupBy("step").count().collect(), reverse=True):
        total += r["count"]
        if total > limit:
            break
        least = r["step"]
    words = [] if least is None else [r["w"] for r in counted.filter(F.col("step") >= least).select("w").collect()]
    scratch.drop(counted)
    return words


def compile_lexicon(spark: SparkSession, texts: DataFrame, merger: Merger, path: str, limit: int = LEXICON_WORDS) -> str:
    """Build the lexicon and hand it to every executor; returns its name for SparkFiles."""
    words = frequent_words(texts, path, merger.vocabulary.odd, Scratch(spark), limit)
    outputs = {w.encode(): ids for w, ids in zip(words, merger.many(words), strict=True)}
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    folder = tempfile.mkdtemp(prefix="probecraft-lexicon-")
    atexit.register(shutil.rmtree, folder, True)  # executors fetch it from the driver, also those that start later
    build_lexicon(sorted(outputs), outputs, f"{folder}/{name}")
    spark.sparkContext.addFile(f"{folder}/{name}")
    return name


class Memory:
    """What is known of keys; those not asked for since the last turn are forgotten at the next."""

    def __init__(self, limit: int):
        self.limit, self.now, self.before = limit, {}, {}

    def lacking(self, keys: Iterable[str]) -> list[str]:
        """The distinct keys that are not known; the others are known from here on until the next turn."""
        if len(self.now) > self.limit:
            self.now, self.before = {}, self.now
        now, before, out = self.now, self.before, []
        for k in dict.fromkeys(keys):
            if k not in now:
                v = before.get(k)
                if v is None:
                    out.append(k)
                else:
                    now[k] = v
        return out


class Codec:
    """Encodes and decodes texts; runs between white space are remembered up to a bound."""

    def __init__(self, path: str, lexicon: str | None = None, odd: Iterable[int] | None = None, letters: str | None = None):
        self.vocabulary = vocabulary_of(path, letters)
        self.merger = Merger(self.vocabulary, odd)
        self.lexicon = Lexicon(lexicon) if lexicon else None
        self.words, self.runs = Memory(MEMO_WORDS), Memory(MEMO_WORDS)
        tokens = self.vocabulary.tokens
        self.numerals = pa.array([str(i) for i in range(max(tokens) + 1)])
        self.spellings = pa.array([tokens.get(i, "") for i in range(max(tokens) + 1)])

    def learn(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of the distinct words: from the memory, the lexicon, or else merged."""
        new = self.words.lacking(words)
        known = self.words.now
        if self.lexicon and new:
            for w, ids in zip(new, self.lexicon.many([w.encode() for w in new]), strict=True):
                if ids is not None:
                    known[w] = ids
            new = [w for w in new if w not in known]
        if new:
            known.update(zip(new, self.merger.many(new), strict=True))
        return known

    def ids_of(self, pieces: list[str]) -> list[int]:
        special = self.vocabulary.special
        known = self.learn(p for p in pieces if p not in special)
        return [i for p in pieces for i in ([special[p]] if p in special else known[p])]

    def encode(self, text: str | None) -> list[int]:
        return self.ids_of(self.vocabulary.pieces(text or ""))

    def decode(self, ids: Iterable[int]) -> str:
        tokens = self.vocabulary.tokens
        return " ".join(tokens[i] for i in ids if i in tokens)

    def coded(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the runs, one after another, and the first of each run (and the end)."""
        new = self.runs.lacking(runs)
        split = [self.vocabulary.words(r) for r in new]
        known, runs_now = self.learn(chain.from_iterable(split)), self.runs.now
        for r, ws in zip(new, split, strict=True):
            runs_now[r] = known[ws[0]] if len(ws) == 1 else [i for w in ws for i in known[w]]
        found = [runs_now[r] for r in runs]
        first = np.cumsum([0, *map(len, found)])
        return np.fromiter(chain.from_iterable(found), np.int64, first[-1]), first

    def many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after another, and the first of each text (and the end)."""
        distinct, place, edge, odd = indexed_runs(self.vocabulary, texts)
        ids, first = self.coded(distinct)
        size = np.diff(first)[place]
        end = np.concatenate([[0], np.cumsum(size)])
        flat = ids[np.arange(end[-1]) + np.repeat(first[place] - end[:-1], size)]
        start = end[edge]
        for i in reversed(odd):
            own = self.encode(texts[i])
            flat = np.concatenate([flat[: start[i]], np.array(own, np.int64), flat[start[i] :]])
            start[i + 1 :] += len(own)
        return flat, start

    def strings(self, flat: np.ndarray, start: np.ndarray) -> list[list[str]]:
        """For each text the ids in decimal, and what they decode to."""
        out = []
        for names in (self.numerals, self.spellings):
            if len(flat) > ARROW_IDS:  # a string array of Arrow ends at 2 GB
                listed = names.to_pylist()
                out.append([" ".join([listed[i] for i in flat[a:b]]) for a, b in zip(start[:-1], start[1:], strict=True)])
            else:
                out.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(start, pa.int32()), names.take(pa.array(flat))), " ").to_pylist())
        return out

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Number of ids, and the digests of the ids as text and of what they decode to."""
        flat, start = self.many(texts)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        return [(n, digest(a), digest(b)) for n, a, b in zip(np.diff(start).tolist(), *self.strings(flat, start), strict=True)]


def encode_documents(spark: SparkSession, docs: DataFrame, path: str | None = None, ids: bool = True) -> DataFrame:
    """The columns of docs with token_ids and decoded (ids=True), or doc_id with n_tokens and the two digests."""
    path = path or vocabulary_path()
    new = "token_ids array<int>, decoded string" if ids else "n_tokens long, ids_sha256 string, decoded_sha256 string"
    names = [x.split()[0] for x in new.split(", ")]
    docs = docs.drop(*names)
    merger = Merger(vocabulary_of(path))
    name, odd, letters = compile_lexicon(spark, docs, merger, path), merger.odd, merger.vocabulary.odd
    at, columns = docs.columns.index("text"), docs.columns
    kept = columns if ids else [c for c in columns if c == "doc_id"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, SparkFiles.get(name), odd, letters)
        gc.disable()  # many small lists, none in a cycle
        try:
            for b in it:
                first = 0
                for texts in chunks(b.column(at)):
                    if ids:
                        flat, start = codec.many(texts)
                        new = [pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(flat, pa.int32())), pa.array(codec.strings(flat, start)[1], pa.string())]
                    else:
                        got = codec.digests(texts)
                        new = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))]
                    yield pa.RecordBatch.from_arrays([*(b.column(columns.index(c)).slice(first, len(texts)) for c in kept), *new], names=[*kept, *names])
                    first += len(texts)
        finally:
            gc.enable()

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.mapInArrow(run, f"{schema}, {new}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_documents(spark, docs, ids=False)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: each document's number of tokens and digests of its ids and their decoding."""
    return encode_documents(spark, docs.select("doc_id", "text"), ids=False)
