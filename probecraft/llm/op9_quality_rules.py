"""Quality rules with host-level verdicts.

Every document gets base counts and a base rule. Failures are summed by host, a beta prior is fitted
to all hosts' failure rates by moments, and each host's rate is shrunk towards it. Documents of a
host whose shrunk rate is above ``max_host_rate`` are dropped with it.

Fixed behaviour: a null text has no words and fails the base rule; a null host is a host of its own;
empty tables give empty results; repeated rows count each; other columns are ignored; with fewer
than two hosts, or hosts of equal rates, the prior is the overall rate with ``default_strength``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Scratch, WordHashes, mix, windows

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
MAX_HOST_RATE, DEFAULT_STRENGTH = 0.6, 20.0
#: Words hashed together before the memory is used again.
CHUNK = 400_000


def _line_repeats(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif line.encode("utf-8", "surrogatepass").strip(SPACES):
            seen.add(line)
    return n


def _repeat_words(docs: list[np.ndarray]) -> list[int]:
    """Words of each document within a 5-word window that the document has at least twice."""
    keys, owner = [], []
    for i, h in enumerate(docs):
        w = windows(h)
        keys.append(mix(w + mix(np.uint64(i + 1) * np.ones(1, np.uint64))[0]))
        owner.append(len(w))
    flat = np.concatenate(keys) if keys else np.empty(0, np.uint64)
    if not len(flat):
        return [0] * len(docs)
    order = np.argsort(flat, kind="stable")
    ranked = flat[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(flat), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    out, at = [], 0
    for h, n in zip(docs, owner, strict=True):
        hit = np.flatnonzero(twice[at : at + n])
        at += n
        if len(hit):
            step = np.zeros(len(h) + 1, np.int64)
            np.add.at(step, hit, 1)
            np.add.at(step, hit + 5, -1)
            out.append(int((np.cumsum(step[:-1]) > 0).sum()))
        else:
            out.append(0)
    return out


def stats_of(texts: list[str | None], hashes: WordHashes) -> dict[str, list[int]]:
    out = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    held: list[np.ndarray] = []
    size = 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        words = data.split()
        out["n_words"].append(len(words))
        out["word_chars"].append(len(text or "") - len(data) + len(data.translate(None, SPACES)))
        out["n_symbols"].append(len(data) - len(data.translate(None, SYMBOLS)))
        out["n_dup_lines"].append(_line_repeats(text or ""))
        held.append(hashes.of(words))
        size += len(words)
        if size >= CHUNK:
            out["n_repeat_words"] += _repeat_words(held)
            held, size = [], 0
    out["n_repeat_words"] += _repeat_words(held)
    return out


def document_stats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """The columns of keep, the base counts and base_failed."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in it:
            got = stats_of(b.column(0).to_pylist(), hashes)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array(v, pa.int64()) for v in got.values())], names=[*keep, *got])

    picked = docs.select("text", *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[1:])
    out = picked.mapInArrow(run, f"{schema}, {STATS}")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT))


def host_verdicts(stats: DataFrame, host: str, max_rate: float = MAX_HOST_RATE, strength: float = DEFAULT_STRENGTH) -> DataFrame:
    """For each host: documents, failures, shrunk failure rate, verdict.

    Moments of the rates give the prior: with mean m and between-host variance v (the variance of the
    rates less their mean sampling variance), its strength is m(1-m)/v - 1.
    """
    hosts = stats.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed"))
    rate = F.col("host_failed") / F.col("host_docs")
    total = hosts.agg(
        (F.sum("host_failed") / F.sum("host_docs")).alias("m"),
        F.var_samp(rate).alias("seen"),
        F.avg(1 / F.col("host_docs")).alias("each"),
    )
    noise = F.col("m") * (1 - F.col("m")) * F.col("each")
    between = F.col("seen") - noise
    fitted = F.greatest(F.lit(1.0), F.least(F.lit(1e6), F.col("m") * (1 - F.col("m")) / between - 1))
    prior = total.select("m", F.when(between > 0, fitted).otherwise(F.lit(strength)).alias("strength"))
    shrunk = (F.col("host_failed") + F.col("m") * F.col("strength")) / (F.col("host_docs") + F.col("strength"))
    return hosts.join(F.broadcast(prior)).select("host", "host_docs", "host_failed", shrunk.alias("host_rate"), (shrunk <= max_rate).alias("host_kept"))


def quality(spark: SparkSession, docs: DataFrame, host: str = "source") -> DataFrame:
    """One row for each document. The counts are written once and read for the hosts and for the join."""
    stats = Scratch(spark).write(document_stats(docs, ("doc_id", host)))
    hosts = host_verdicts(stats, host)
    joined = stats.join(hosts, stats[host].eqNullSafe(hosts["host"]), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("host_kept")).alias("kept"), F.col(host).alias("host"), "host_rate")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same rules in plain SQL.
SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM d WHERE len(ws) >= 5),
w AS (SELECT doc_id, i, list_slice(ws, i, i + 4) AS k FROM g),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM w),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r WHERE c >= 2) GROUP BY doc_id),
l AS (SELECT doc_id, sum(c - 1) AS n FROM (SELECT doc_id, line, count(*) AS c FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line) GROUP BY doc_id),
s AS (SELECT d.doc_id, source, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN cov ON cov.doc_id = d.doc_id),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM s),
h AS (SELECT source AS host, count(*) AS n, sum(base_failed::INT) AS f FROM b GROUP BY source),
p AS (SELECT sum(f) / sum(n) AS m, var_samp(f / n) AS seen, avg(1 / n) AS each FROM h),
q AS (SELECT m, CASE WHEN seen - m * (1 - m) * each > 0 THEN greatest(1.0, least(1e6, m * (1 - m) / (seen - m * (1 - m) * each) - 1)) ELSE 20.0 END AS k FROM p),
v AS (SELECT host, (f + m * k) / (n + k) AS host_rate FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND host_rate <= 0.6) AS kept, host, host_rate
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.host
"""
