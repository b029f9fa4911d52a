"""Recordings: answers by request key, vectors by text key, and a demo folder that holds both with its corpus.

Tables are Parquet folders; a recording that isn't there is an empty one, so that recording can begin.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import vector_key
from ..operators.chunking import ChunkingPolicy
from ..operators.retrieval import RetrievalPolicy, frozen
from ..plans.experiment import AblationPolicy
from .corpus import exists, load_documents, validate_documents

ANSWERS = "request_key string, answer string, input_tokens long, output_tokens long, cost_usd double, cached boolean"


def load_answers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANSWERS).parquet(path) if exists(spark, path) else spark.createDataFrame([], ANSWERS)


def save_answers(answers: DataFrame, path: str) -> None:
    """One row for each request, in order of its key; parent folders are made."""
    if not path:
        raise ValueError("a recording needs a path")
    have = {c.split()[0]: c.split()[1] for c in ANSWERS.split(", ")}
    rows = answers.select(*(F.col(c).cast(k) if c in answers.columns else F.lit(None).cast(k).alias(c) for c, k in have.items()))
    rows.dropDuplicates(["request_key"]).sort("request_key").write.mode("overwrite").parquet(path)


def replaying(answers: DataFrame):
    """A generator of recorded answers; a request without one raises."""

    def generate(asked: DataFrame) -> DataFrame:
        missing = asked.join(answers, "request_key", "left_anti").select("request_key").limit(1).collect()
        if missing:
            raise LookupError(f"request {missing[0][0][:12]} is not in the recording")
        return answers.withColumn("cached", F.lit(True)).join(asked.select("request_key").distinct(), "request_key", "left_semi")

    return generate


def recording(answers: DataFrame, generate):
    """A generator that asks generate only for what answers lacks, and says of each answer whether it was recorded."""

    def run(asked: DataFrame) -> DataFrame:
        names = ["request_key", "answer", "input_tokens", "output_tokens"]
        old = answers.join(asked.select("request_key").distinct(), "request_key", "left_semi").select(*names, F.lit(True).alias("cached"))
        new = generate(asked.join(answers, "request_key", "left_anti")).select(*names, F.lit(False).alias("cached"))
        return old.unionByName(new)

    return run


def frozen_vectors(spark: SparkSession, path: str, model: str, dims: int):
    """An embedder of recorded vectors, looked up by text key; a text without one raises."""
    known = spark.read.parquet(path).filter((F.col("model") == model) & (F.col("dims") == dims)).select("text_key", "vec")

    def embed(texts: DataFrame) -> DataFrame:
        keyed = texts.select("text").distinct().withColumn("text_key", vector_key(F.col("text")))
        return frozen(keyed.join(known, "text_key").select("text", "vec"))(texts)

    return embed


@dataclass(frozen=True)
class Demo:
    """A recorded corpus with everything that is asked of it."""

    documents: DataFrame
    questions: tuple[str, ...]
    embed: object
    generate: object
    chunking: ChunkingPolicy
    retrieval: RetrievalPolicy
    ablation: AblationPolicy
    title: str = ""
    blurb: str = ""
    probes: tuple[dict, ...] = ()
    labels: tuple[dict, ...] = ()
    more: dict = field(default_factory=dict)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def load_demo(spark: SparkSession, folder: str) -> Demo:
    """manifest.json, corpus.jsonl, vectors and answers of a folder; without a manifest there is no demo."""
    if not exists(spark, f"{folder}/manifest.json"):
        raise FileNotFoundError(f"no recording at {folder}")
    m = json.loads(read_text(spark, f"{folder}/manifest.json"))
    documents = validate_documents(load_documents(spark, f"{folder}/corpus.jsonl"))
    embed = frozen_vectors(spark, f"{folder}/vectors", m["embedder"], m["dims"])
    generate = replaying(load_answers(spark, f"{folder}/answers"))
    known = ("title", "blurb", "questions", "chunking", "retrieval", "ablation", "probes", "labels", "embedder", "dims")
    return Demo(documents, tuple(m["questions"]), embed, generate, ChunkingPolicy(**m.get("chunking", {})), RetrievalPolicy(**m.get("retrieval", {})), AblationPolicy(**m.get("ablation", {})), m.get("title", ""), m.get("blurb", ""), tuple(m.get("probes", ())), tuple(m.get("labels", ())), {k: v for k, v in m.items() if k not in known})


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small file of the driver's, through Spark's file systems."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_manifest(spark: SparkSession, folder: str, questions: list[str], embedder: str, dims: int, **more) -> None:
    """manifest.json with what load_demo reads and whatever else is given (title, blurb, policies, probes, labels, results)."""
    write_text(spark, json.dumps({"questions": list(questions), "embedder": embedder, "dims": dims, **more}, ensure_ascii=False, indent=2), f"{folder}/manifest.json")
