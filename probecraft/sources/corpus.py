"""Document sources, validation and sinks."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import strip, title

#: Suffixes that a folder scan takes.
SUFFIXES = (".txt", ".md", ".markdown", ".rst")
SCHEMA = "doc_id string, title string, text string, meta map<string,string>, doc_ord long"


class CorpusError(ValueError):
    """A corpus that can't be used; the message says where."""


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, title, text, meta, doc_ord of a folder, a .jsonl or .ndjson file, or one file of any kind."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target):
        raise FileNotFoundError(path)
    if fs.getFileStatus(target).isDirectory():
        return _folder(spark, path)
    return _jsonl(spark, path) if path.lower().endswith((".jsonl", ".ndjson")) else _files(spark.read.text(path, wholetext=True), os.path.dirname(path))


def _files(raw: DataFrame, root: str) -> DataFrame:
    full = F.regexp_replace(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")), "^[a-z]+:/+", "/")
    rel = F.expr("path").substr(F.lit(len(root.rstrip("/")) + 2), F.length("path"))
    rows = raw.select(full.alias("path"), F.col("value").alias("text")).withColumn("rel", rel)
    name = F.regexp_replace("rel", r"\.[^./]*$", "")
    # Ordinals ascend with the sorted names; partitions of the sort are ranges, so no task sees all of them.
    return rows.sort(F.split("rel", "/")).select(name.alias("doc_id"), title(F.col("text"), F.regexp_extract(name, "[^/]*$", 0)).alias("title"), "text", F.create_map(F.lit("path"), F.col("path")).alias("meta"), F.monotonically_increasing_id().alias("doc_ord"))


def _folder(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    kept = raw.filter(F.lower("_metadata.file_name").rlike(r"\.(txt|md|markdown|rst)$"))
    out = _files(kept, path.replace("file://", ""))
    if out.isEmpty():
        raise CorpusError(f"no {', '.join(SUFFIXES)} files under {path}")
    return out


def _jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Lines are read in splits and numbered by the counts of the splits before; the first that isn't a document raises with its number."""
    raw = spark.read.text(path).select(F.col("value").alias("line"), F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() % (1 << 33)).alias("i"), F.col("_metadata.file_block_start").alias("at"))
    sizes = raw.groupBy("part").agg(F.count(F.lit(1)).alias("lines"), F.min("at").alias("at")).collect()  # a row for each split
    first, total = [], 0
    for r in sorted(sizes, key=lambda r: r["at"]):
        first.append((r["part"], total))
        total += r["lines"]
    offsets = spark.createDataFrame(first or [(0, 0)], "part int, before long")
    lines = raw.join(F.broadcast(offsets), "part").select((F.col("i") + F.col("before") + 1).alias("n"), "line").filter(strip(F.col("line")) != "")
    kind = "doc_id string, id string, title string, text string, meta map<string,string>, _bad string"
    rows = lines.withColumn("j", F.from_json("line", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})).withColumn("keys", F.json_object_keys("line"))
    bad = rows.filter(F.col("j._bad").isNotNull() | F.col("keys").isNull() | F.col("j.text").isNull()).orderBy("n").limit(1).collect()
    if bad:
        raise CorpusError(f"{path} line {bad[0]['n']}: not a JSON object with text")
    if rows.isEmpty():
        raise CorpusError(f"{path} holds no documents")
    has = lambda k: F.array_contains("keys", k)
    number = F.col("n").cast("string")
    name = F.when(has("doc_id"), F.col("j.doc_id")).when(has("id"), F.col("j.id")).otherwise(number)
    meta = F.map_concat(F.coalesce("j.meta", F.create_map().cast("map<string,string>")), F.create_map(F.lit("source"), F.lit(path), F.lit("line"), number))
    return rows.select(name.alias("doc_id"), F.coalesce(F.nullif(F.col("j.title"), F.lit("")), F.concat(F.lit("document "), number)).alias("title"), F.col("j.text").alias("text"), meta.alias("meta"), F.col("n").cast("long").alias("doc_ord"))


def location(meta: Column, name: Column) -> Column:
    """source line N, path, or document titled ..."""
    return F.coalesce(F.when(meta["line"].isNotNull(), F.concat(meta["source"], F.lit(" line "), meta["line"])), meta["path"], F.concat(F.lit("document titled "), name))


def duplicate_ids(docs: DataFrame) -> DataFrame:
    return docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set(location(F.col("meta"), F.col("title")))).alias("places")).filter("n > 1")


#: Problems that one error lists of each kind.
REPORTED = 20


def validate_documents(docs: DataFrame) -> DataFrame:
    """docs, if every id is a non-blank string without outer space and unique; else raises before any costly work."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    if kind != "string":
        raise CorpusError(f"document ids are strings, not {kind}")
    bad = docs.filter(F.col("doc_id").isNull() | (F.col("doc_id") == "") | (strip(F.col("doc_id")) != F.col("doc_id")))
    said = [f"invalid id {r[0]!r}: {r[1]}" for r in bad.select("doc_id", location(F.col("meta"), F.col("title"))).limit(REPORTED).collect()]
    said += [f"duplicate id {r['doc_id']}: {', '.join(r['places'])}" for r in duplicate_ids(docs).orderBy("doc_id").limit(REPORTED).collect()]
    if said:
        raise CorpusError("; ".join(said))
    if docs.isEmpty():
        raise CorpusError("the corpus is empty")
    return docs


def validate_chunks(chunks: DataFrame) -> DataFrame:
    twice = chunks.groupBy("chunk_id").count().filter("count > 1").limit(1).collect()
    if twice:
        raise CorpusError(f"duplicate chunk id {twice[0]['chunk_id']}")
    if chunks.isEmpty():
        raise CorpusError("the corpus has no chunks")
    return chunks


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def beside(spark: SparkSession, corpus: str, name: str) -> str:
    """The path of a sidecar: in a corpus folder, or in the folder of a corpus file."""
    target = spark._jvm.org.apache.hadoop.fs.Path(corpus)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    folder = target if fs.exists(target) and fs.getFileStatus(target).isDirectory() else target.getParent()
    return f"{folder.toString()}/{name}"


def sidecar_lines(spark: SparkSession, path: str) -> DataFrame:
    """questions.txt: stripped lines that aren't blank and don't start with #; a missing file raises."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.text(path).filter("not startswith(value, '#')").select(strip(F.col("value")).alias("question")).filter("question <> ''")


def sidecar_json(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """Records of one field of a JSON file (probes or labels); a missing file has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{field} array<struct<{schema}>>").json(path, multiLine=True).select(F.explode(field).alias("r")).select("r.*")


def describe(docs: DataFrame, chunks: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, title, characters of the documents, and how many chunks there are."""
    return docs.select("doc_id", "title", F.char_length("text").alias("characters")), chunks.count()


def fetch(docs: DataFrame, doc_id: str) -> dict:
    """One document whole; an id that isn't there raises."""
    found = docs.filter(F.col("doc_id") == doc_id).select("doc_id", "title", "text").limit(1).collect()
    if not found:
        raise LookupError(f"no document {doc_id!r}")
    return found[0].asDict()


def read_vectors(spark: SparkSession, path: str, model: str, dims: int) -> DataFrame:
    """Cached vectors of one model and size; others are ignored."""
    return spark.read.parquet(path).filter((F.col("model") == model) & (F.col("dims") == dims)).select("text_key", "vec")


def write_vectors(vectors: DataFrame, path: str, model: str, dims: int) -> None:
    vectors.withColumns({"model": F.lit(model), "dims": F.lit(dims)}).write.mode("append").partitionBy("model", "dims").parquet(path)


def write_corpus(docs: DataFrame, path: str) -> None:
    docs.select(F.to_json(F.struct("doc_id", "title", "text")).alias("value")).write.text(path)


def write_json(value: dict, path: str) -> None:
    """A small driver-side report or manifest."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2, sort_keys=True)
