"""Sentence-aligned chunks: one ordered fold for each document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import sentence_spans, word_count


@dataclass(frozen=True)
class ChunkingPolicy:
    target_words: int = 110
    overlap_sentences: int = 1
    max_words: int = 220

    def __post_init__(self):
        if self.target_words < 1 or self.overlap_sentences < 0 or self.max_words < self.target_words:
            raise ValueError("target_words >= 1, overlap_sentences >= 0 and max_words >= target_words are needed")


_SPAN = "struct<text:string,start:int,end:int,n:int>"
_CHUNK = "array<struct<text:string,start:int,end:int>>"


def _cover(group: Column) -> Column:
    return F.struct(F.array_join(F.transform(group, lambda s: s["text"]), " ").alias("text"), F.get(group, F.lit(0))["start"].alias("start"), F.element_at(group, -1)["end"].alias("end"))


def _pieces(span: Column, size: int) -> Column:
    """A long sentence in runs of size words, with the original white space and offsets."""
    words = F.filter(F.split(span["text"], r"(?U)(?<=\S)(?=\s)|(?<=\s)(?=\S)"), lambda w: w != "")
    runs = F.transform(F.sequence(F.lit(1), F.size(words), F.lit(2 * size)), lambda i: F.struct(
        F.char_length(F.array_join(F.slice(words, F.lit(1), i - 1), "")).alias("at"),
        F.regexp_replace(F.array_join(F.slice(words, i, F.lit(2 * size)), ""), r"(?U)\s+$", "").alias("text")))
    return F.transform(runs, lambda r: F.struct(r["text"].alias("text"), (span["start"] + r["at"]).alias("start"), (span["start"] + r["at"] + F.char_length(r["text"])).alias("end")))


def pack(spans: Column, policy: ChunkingPolicy) -> Column:
    """Greedy packing: emit at the target, carry the last sentences over, split a long sentence that stands alone."""
    counted = F.transform(spans, lambda s: F.struct(s["text"].alias("text"), s["start"].alias("start"), s["end"].alias("end"), word_count(s["text"]).alias("n")))
    zero = F.struct(F.array().cast(f"array<{_SPAN}>").alias("group"), F.array().cast(_CHUNK).alias("out"))
    total = lambda g: F.aggregate(g, F.lit(0), lambda a, s: a + s["n"])

    def step(acc: Column, s: Column) -> Column:
        alone = (F.size(acc["group"]) == 0) & (s["n"] > policy.max_words)
        group = F.concat(acc["group"], F.array(s))
        full = total(group) >= policy.target_words
        kept = F.least(F.lit(policy.overlap_sentences), F.size(group) - 1)
        carried = F.slice(group, F.size(group) - kept + 1, kept)
        return (
            F.when(alone, F.struct(acc["group"].alias("group"), F.concat(acc["out"], _pieces(s, policy.max_words)).alias("out")))
            .when(full, F.struct(carried.alias("group"), F.concat(acc["out"], F.array(_cover(group))).alias("out")))
            .otherwise(F.struct(group.alias("group"), acc["out"].alias("out")))
        )

    def finish(acc: Column) -> Column:
        rest = _cover(acc["group"])
        new = (F.size(acc["group"]) > 0) & ((F.size(acc["out"]) == 0) | (F.element_at(F.concat(acc["out"], F.array(rest)), F.greatest(F.size(acc["out"]), F.lit(1))) != rest))
        return F.when(new, F.concat(acc["out"], F.array(rest))).otherwise(acc["out"])

    return F.aggregate(counted, zero, step, finish)


def chunk_documents(docs: DataFrame, policy: ChunkingPolicy | None = None) -> DataFrame:
    """doc_id, ordinal, chunk_id, text, start, end; documents are independent, so nothing shuffles."""
    policy = policy or ChunkingPolicy()
    rows = docs.withColumn("_spans", sentence_spans(F.col("text"))).select("doc_id", F.posexplode(pack(F.col("_spans"), policy)).alias("ordinal", "c"))
    return rows.select("doc_id", "ordinal", F.concat(F.col("doc_id").cast("string"), F.lit("#"), F.col("ordinal").cast("string")).alias("chunk_id"), "c.text", "c.start", "c.end")
