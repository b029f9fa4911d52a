"""Soft-membership mixing to target weights, with DataFrame functions only.

A naive Bayes classifier learnt from the labelled table gives every document a posterior over domains. Document
rates r >= 0 then minimise the squared distance between the expected token totals of the domains,
sum of r * tokens * posterior, and their targets, by projected gradient steps from r = 1. The gradient of a document
depends on its posterior alone: the driver keeps one vector of domains per step and every document replays them.
Distances are scaled by the inverse of the domains' second moments. Steps are long and implicit: the gradient is that
at the step's end, found by damped Newton iterations over one number per domain, each a small aggregation. Steps end when the targets
are met, or when a bound from the gradient proves that no rates come nearer; else fitting fails.

Fixed behaviour: null texts have no tokens, posteriors of the priors and the rate of their posterior; labels with null parts or
no document teach nothing; repeated rows count each; target domains that no label has are left out and the
rest rescaled; without any label there is one domain ``all``; empty tables give empty results; further columns are
kept by ``mix``, whatever their names (those of its own four are replaced); ties of a posterior go to the first domain in alphabetical order.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import Scratch

#: Labelled rows that teach the classifier, words it looks at, bins of each measure.
SAMPLE, WORDS, BINS = 20_000, 64, 8
#: Miss allowed, as a share of the tokens; part of the metric that a step keeps (its length is the inverse); bounds at which fitting fails.
TOLERANCE, DAMPING, ROUNDS, NEWTON = 1e-4, 1e-8, 16, 64
#: Shares of the tokens wanted, by quality and toxicity.
TARGETS = {"q1_t0": 0.85, "q0_t0": 0.10, "q1_t1": 0.04, "q0_t1": 0.01}
SPACE = r"[\x20\x09-\x0D]+"
OWN = ("tokens", "domain", "posterior", "rate")


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def measures(text: Column, ws: Column, distinct: Column) -> dict[str, Column]:
    """Shape of a text, 0 to 1 or a logarithm."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t) + F.lit(1.0)
    return {
        "symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>!@=~^{}\[\]\\_]")) / n,
        "digits": F.regexp_count(t, F.lit("[0-9]")) / n,
        "capitals": F.regexp_count(t, F.lit("[A-Z]")) / n,
        "variety": F.size(distinct) / (F.size(ws) + F.lit(1.0)),
        "length": F.log(n),
    }


def featured(docs: DataFrame) -> DataFrame:
    """docs with tokens, the distinct lower-case words and the measures."""
    out = docs.withColumn("_ws", words(F.lower("text"))).withColumn("_set", F.array_distinct("_ws")).withColumn("tokens", F.size("_ws").cast("long"))
    return out.withColumns({f"_m_{k}": v for k, v in measures(F.col("text"), F.col("_ws"), F.col("_set")).items()}).drop("_ws")


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, sample: int = SAMPLE, n_words: int = WORDS) -> dict:
    """Priors, bin edges and log odds. The sample is the labelled rows with the lowest hashes."""
    named = labels.filter("doc_id is not null and quality is not null and toxic is not null").select("doc_id", F.concat(F.lit("q"), F.col("quality"), F.lit("_t"), F.col("toxic")).alias("domain"))
    picked = named.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(sample)
    rows = scratch.write(featured(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")).drop("text"))
    counts = {r["domain"]: r["count"] for r in rows.groupBy("domain").count().collect()}
    domains = sorted(counts)
    if not domains:
        return {"domains": ["all"], "prior": [0.0], "edges": {}, "bins": {}, "words": {}}
    total = sum(counts.values())
    kinds = [c[3:] for c in rows.columns if c.startswith("_m_")]
    quantiles = [i / BINS for i in range(1, BINS)]
    got = rows.agg(*(F.percentile_approx(f"_m_{k}", quantiles, 10_000).alias(k) for k in kinds)).first()
    edges = {k: sorted(set(got[k])) for k in kinds}
    bins = {}
    for k in kinds:
        table = {(r["b"], r["domain"]): r["count"] for r in rows.groupBy(bin_of(F.col(f"_m_{k}"), edges[k]).alias("b"), "domain").count().collect()}
        m = len(edges[k]) + 1
        bins[k] = [[math.log((table.get((b, d), 0) + 1) / (counts[d] + m)) for d in domains] for b in range(m)]
    each = rows.select("domain", F.explode("_set").alias("w")).groupBy("w").agg(*(F.count(F.when(F.col("domain") == d, 1)).alias(f"c{i}") for i, d in enumerate(domains)), F.count(F.lit(1)).alias("c"))
    # Gain of a word: how far its documents' domains are from the priors.
    gain = sum((F.col(f"c{i}") + 0.5) * F.log((F.col(f"c{i}") + 0.5) / ((F.col("c") + 0.5 * len(domains)) * counts[d] / total)) for i, d in enumerate(domains))
    chosen = each.filter("c >= 5").orderBy(F.desc(F.round(gain, 9)), "w").limit(n_words).collect()
    odds, absent = {}, [math.log(counts[d] / total) for d in domains]
    for r in chosen:
        p = [(r[f"c{i}"] + 0.5) / (counts[d] + 1) for i, d in enumerate(domains)]
        odds[r["w"]] = [math.log(x / (1 - x)) for x in p]
        absent = [a + math.log(1 - x) for a, x in zip(absent, p, strict=True)]
    scratch.drop(rows)
    return {"domains": domains, "prior": absent, "edges": edges, "bins": bins, "words": odds}


def bin_of(value: Column, edges: list[float]) -> Column:
    """Number of edges that value reaches. The outer array has value computed once, not for each edge."""
    reached = lambda v: F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= v))
    return F.element_at(F.transform(F.array(value), reached), 1) if edges else F.lit(0)


def posterior(model: dict) -> tuple[Column, Column]:
    """Log odds of a featured row for each domain, and their exponentials less the largest (from column _logit)."""
    k = range(len(model["domains"]))
    row = lambda x: F.array(*map(F.lit, x))
    parts = [row(model["prior"])]
    for name, table in model["bins"].items():
        parts.append(F.element_at(F.array(*map(row, table)), bin_of(F.col(f"_m_{name}"), model["edges"][name]) + 1))
    if model["words"]:
        names = sorted(model["words"])
        known = F.array(*map(F.lit, names))
        table = F.array(*(row(model["words"][w]) for w in names))
        hits = F.transform(F.array_intersect("_set", known), lambda w: F.element_at(table, F.array_position(known, w).cast("int")))
        parts.append(F.aggregate(hits, row([0.0 for _ in k]), lambda a, x: F.zip_with(a, x, lambda p, q: p + q)))
    total = parts[0]
    for p in parts[1:]:
        total = F.zip_with(total, p, lambda a, b: a + b)
    most = F.array_max("_logit")
    return total, F.transform("_logit", lambda x: F.exp(x - most))


def with_posterior(docs: DataFrame, model: dict, texts: bool = True) -> DataFrame:
    """docs (without their text, if texts is False) with tokens, domain and posterior. Given columns lie in a struct, apart from those of the model."""
    given = [c for c in docs.columns if c not in OWN and (texts or c != "text")]
    logit, weight = posterior(model)
    out = featured(docs.select(F.struct(*(docs[c] for c in given)).alias("given"), "text")).withColumn("_logit", logit).withColumn("_e", weight)
    out = out.withColumn("posterior", F.transform("_e", lambda x: x / F.aggregate("_e", F.lit(0.0), lambda a, y: a + y)))
    names = F.array(*map(F.lit, model["domains"]))
    out = out.withColumn("domain", F.element_at(names, F.array_position("posterior", F.array_max("posterior")).cast("int")))
    return out.select(*(F.col("given").getField(c).alias(c) for c in given), "tokens", "domain", "posterior")


def rated(rows: DataFrame, steps: list[np.ndarray]) -> DataFrame:
    """rows (with posterior) with rate: the replay of projected steps from rate 1.

    The vectors are one array, which folds into a single literal, so that every round has one compiled stage.
    """
    vectors = F.array(*(F.array(*(F.lit(float(x)) for x in s)) for s in steps)).cast("array<array<double>>")
    dot = lambda g: F.aggregate(F.zip_with("posterior", g, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return rows.withColumn("rate", F.aggregate(vectors, F.lit(1.0), lambda r, g: F.greatest(F.lit(0.0), r - dot(g))))


def fit_rates(posteriors: DataFrame, domains: list[str], targets: dict[str, float]) -> list[np.ndarray]:
    """Steps whose replay gives rates that meet the targets, from (tokens, posterior) rows.

    A step that ends within TOLERANCE of the targets is the last. Otherwise the last is one whose miss is proven, by a
    lower bound over all nonnegative rates, to be the least there is; the shares reached are then given in a warning.
    """
    k = len(domains)
    p, t, r = F.col("posterior"), F.col("tokens").cast("double"), F.col("rate")
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    sums = [F.sum(r * t * p[i]) for i in range(k)] + [F.sum(F.when(r > 0, t * p[i] * p[j]).otherwise(0.0)) for i, j in upper] + [F.sum(t * r * r), F.sum(t)]

    def look(at: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, float, float]:
        """Totals of the domains, second moments of the rows in use, weighed square and tokens at the rates of these steps."""
        got = [x or 0.0 for x in rated(posteriors, at).agg(*(c.alias(f"s{n}") for n, c in enumerate(sums))).first()]
        moments = np.zeros((k, k))
        for (i, j), x in zip(upper, got[k:], strict=False):
            moments[i, j] = moments[j, i] = x
        return np.array(got[:k]), moments, got[-2], got[-1]

    totals, used, square, tokens = look([])
    if not tokens:
        return []
    wanted = np.array([max(0.0, targets.get(d, 0.0)) for d in domains])
    wanted = (wanted / wanted.sum() if wanted.sum() else np.full(k, 1 / k)) * tokens
    scale = used + 1e-9 * np.trace(used) * np.eye(k)
    inverse = np.linalg.inv(scale)
    out: list[np.ndarray] = []
    for _ in range(ROUNDS):
        if np.abs(totals - wanted).sum() <= TOLERANCE * tokens:
            return out
        step = np.zeros(k)
        value = square / 2
        for _ in range(NEWTON):
            slope = wanted - totals + DAMPING * scale @ step
            if np.abs(slope).sum() <= TOLERANCE / 10 * tokens:
                break
            move, part = np.linalg.solve(used + DAMPING * scale, slope), 1.0
            while True:
                trial = step - part * move
                totals, used, square, _ = look([*out, trial])
                new = square / 2 + wanted @ trial + DAMPING / 2 * trial @ scale @ trial
                if new <= value - 1e-4 * part * (slope @ move) + 1e-12 * abs(value) or part < 1e-4:
                    break
                part /= 2
            step, value = trial, new
        out.append(step)
        error = totals - wanted
        if np.abs(error).sum() <= TOLERANCE * tokens:
            return out
        miss = math.sqrt(error @ inverse @ error / tokens)
        # Prices at which no document costs less than nothing bound every miss from below.
        price = inverse @ error
        cost = F.aggregate(F.zip_with("posterior", F.array(*(F.lit(float(x)) for x in price)), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        price = price + max(0.0, -posteriors.filter("tokens > 0").agg(F.min(cost)).first()[0])
        least = math.sqrt(max(0.0, -2 * price @ wanted - price @ scale @ price) / tokens)
        if miss - least <= TOLERANCE:
            break
    reached = ", ".join(f"{d} {x / tokens:.5f} for {w / tokens:.5f}" for d, x, w in zip(domains, totals, wanted, strict=True))
    if miss - least > TOLERANCE:
        raise ArithmeticError(f"rates did not come to their optimum in {ROUNDS} rounds; shares: {reached}")
    warnings.warn(f"no nonnegative rates come nearer to the targets; shares: {reached}", stacklevel=2)
    return out


def mix(spark: SparkSession, docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, texts: bool = True) -> DataFrame:
    """docs with tokens, domain, posterior and rate, without their text if texts is False.

    Each text is looked at once: posteriors are written with the rows, as an optimiser that puts their
    expressions into the replay and into later filters would evaluate them many times a row.
    """
    scratch = Scratch(spark)
    model = fit(docs, labels, scratch)
    known = scratch.write(with_posterior(docs, model, texts))
    return rated(known, fit_rates(known.select("tokens", "posterior"), model["domains"], targets or TARGETS))


def resample(mixed: DataFrame, seed: int = 11) -> DataFrame:
    """Each row floor(rate) times, and once more with probability of the rest, drawn by hash."""
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = F.floor(F.col("rate") + draw).cast("int")
    again = F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))
    return mixed.select(F.struct(*(mixed[c] for c in mixed.columns)).alias("row"), F.explode(again)).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    mixed = mix(spark, docs.select("doc_id", "text"), labels, texts=False)
    return mixed.select("doc_id", "tokens", "domain", F.array_max("posterior").alias("certainty"), "rate")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out at their rates."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return resample(mix(spark, docs, labels)).select(*docs.columns)
