"""Language identification by compression.

Every language has a raw-content zstandard dictionary made from labelled texts. A text goes to the
language whose dictionary gives the fewest compressed bytes; narrow margins are marked as rejected, in texts of any length.

Fixed behaviour: null texts and texts without a letter give ``und`` with score 0 and are rejected;
empty tables give empty results; repeated rows are scored alike; ties go to the language first in
alphabetical order; columns beyond doc_id, text and lang are ignored. Without any labelled text
every answer is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Bounds of the training sample: texts for each language, and characters of each text.
TEXTS, CHARS = 256, 1024
LEVEL = 3
#: Bytes compressed at a time.
BLOCK = 2048
#: Relative margin between the two smallest sizes below which a prediction is rejected.
MARGIN = 0.004


def fit(labelled: DataFrame, texts: int = TEXTS, chars: int = CHARS) -> dict[str, bytes]:
    """Dictionaries from a bounded sample: the labelled texts with the lowest hashes of doc_id, each from a hashed position."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    usable = labelled.filter("lang is not null and text is not null and doc_id is not null and lang <> 'und'")
    picked = usable.select("doc_id", "lang").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= texts).select("doc_id").distinct()
    start = (F.pmod(F.xxhash64("doc_id", F.lit("start")), F.greatest(F.lit(1), F.length(F.lower("text")) - chars + 1)) + 1).cast("int")
    rows = usable.join(F.broadcast(picked), "doc_id").select("lang", "doc_id", F.substring(F.lower("text"), start, F.lit(chars)).alias("text")).distinct().collect()
    out: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["doc_id"], r["text"])):
        out.setdefault(r["lang"], []).append(r["text"])
    return {k: "\n".join(v).encode() for k, v in out.items()}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        import zstandard as z

        self.names, self.models = sorted(dictionaries), []
        for name in self.names:
            d = z.ZstdCompressionDict(dictionaries[name], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.models.append(z.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def sizes(self, data: bytes) -> list[int]:
        """Compressed bytes of the whole text, block by block, so that a long text does not become its own dictionary."""
        parts = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return [sum(len(m.compress(p)) for p in parts) for m in self.models]

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.names or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        data = text.lower().encode("utf-8", "surrogatepass")
        sizes = self.sizes(data)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
        score = (rest - sizes[best]) / rest
        return self.names[best], score, score < MARGIN


def predict(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """All columns of docs with lang_pred, score and rejected; only text decides."""
    docs = docs.drop("lang_pred", "score", "rejected")
    columns = docs.columns
    at = columns.index("text")
    model = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(model.value)
        for b in it:
            got = [classify(t) for t in b.column(at).to_pylist()]
            new = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*columns, "lang_pred", "score", "rejected"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double, rejected boolean")


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.filter(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rejected documents; the rest keep their columns."""
    model = fit(docs.filter(~held_out()))
    return predict(docs, model).filter("not rejected").select(*docs.columns)
