"""Registered queries over whole test tables, and the SQL that must agree with them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..operators import chunking, retrieval as R
from ..sources import corpus
from ..streaming import events as E
from . import ask as A, experiment as X, report

QUERIES, ORACLES = {}, {}


def registered(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark, sf):
    return table(spark, sf, "documents")


def as_chunks(spark, sf) -> DataFrame:
    """Whole documents as chunks."""
    return documents(spark, sf).select(F.col("doc_id").alias("chunk_id"), "text")


def asked(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def turns(spark, sf) -> DataFrame:
    """Conversation turns as chunks with a place in their document."""
    c = table(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ordinal"), F.concat_ws("#", "conv_id", "turn").alias("chunk_id"), "text", "role")


def fraction(*key) -> F.Column:
    """A fixed number in 0 to 1 from a key, for tables of scores that the test data lack."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *key)), 1, 8), 16, 10).cast("double") / 4294967296.0


STOP = "('" + "','".join(T.STOPWORDS) + "')"
TOKENS = f"list_filter(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9''_-]*'), lambda w: w NOT IN {STOP})"
FRACTION = "(concat('0x', substr(md5({}), 1, 8))::BIGINT / 4294967296.0)"


@registered(f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct FROM (SELECT doc_id, {TOKENS} AS t FROM documents)")
def tokenize_counts(spark, sf):
    t = T.tokenize(F.col("text"))
    return documents(spark, sf).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@registered(f"""WITH p AS (SELECT DISTINCT doc_id, unnest({TOKENS}) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents)
SELECT term, count(*) AS df, round(ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM p, n GROUP BY term""")
def term_document_frequency(spark, sf):
    docs = as_chunks(spark, sf)
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    df = docs.select("chunk_id", F.explode(F.array_distinct(T.tokenize(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.join(F.broadcast(n)).select("term", "df", F.round(R.term_stats(df, F.col("n")), 6).alias("idf"))


BM25 = f"""WITH tk AS (SELECT doc_id, {TOKENS} AS t FROM documents), ln AS (SELECT doc_id, len(t) AS len FROM tk),
st AS (SELECT count(*) AS n, avg(len) AS mean FROM ln), p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tk) GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM p GROUP BY term), q AS (SELECT item_id, term, count(*) AS m FROM (SELECT item_id, unnest({TOKENS}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id AS qid, doc_id, sum(m * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))) AS score FROM p JOIN q USING (term) JOIN d USING (term) JOIN ln USING (doc_id), st GROUP BY ALL),
r AS (SELECT qid, doc_id AS chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank FROM s WHERE score > 0)
"""


@registered(BM25 + "SELECT qid, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank < 24")
def bm25_topk(spark, sf):
    return R.bm25(as_chunks(spark, sf), asked(spark, sf)).select("qid", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@registered(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::BIGINT AS n_words FROM documents")
def word_counts(spark, sf):
    return documents(spark, sf).select("doc_id", T.word_count(F.col("text")).cast("long").alias("n_words"))


@registered(r"SELECT doc_id, coalesce(left(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '^\s+', ''), '^#+', ''), '^\s+', ''), '\s+$', '')), lambda x: x <> '')[1], 120), doc_id::VARCHAR) AS title FROM documents")
def title_extract(spark, sf):
    return documents(spark, sf).select("doc_id", T.title(F.col("text"), F.col("doc_id").cast("string")).alias("title"))


@registered("SELECT doc_id, CASE WHEN length(text) <= 220 THEN text ELSE concat(regexp_replace(left(text, 219), '\\s+$', ''), '…') END AS excerpt FROM documents")
def excerpts(spark, sf):
    return documents(spark, sf).select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


@registered("SELECT doc_id, left(sha256(text), 32) AS vector_key FROM documents")
def vector_keys(spark, sf):
    return documents(spark, sf).select("doc_id", T.vector_key(F.col("text")).alias("vector_key"))


CLAIM = "(?is)^(?:here(?:''s|\\s+(?:is|are))\\b.*|the\\s+(?:context|documents?|sources?|passages?|excerpts?)\\b.{0,60}(?:does\\s+not|do\\s+not|don''t|doesn''t|never)\\b.*|i\\s+(?:hope|can|could|cannot|can''t|don''t|do\\s+not|was|am)\\b.*|let\\s+me\\s+know\\b.*|[^\\p{L}\\p{N}_]*)$"


@registered(rf"""WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS s FROM conversations)
SELECT conv_id, turn, count(*) AS n_lines, count_if(trim(s) <> '' AND NOT regexp_matches(trim(s), '{CLAIM}') AND len(list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> '')) >= 3)::BIGINT AS n_claims FROM l GROUP BY ALL""")
def claim_filter(spark, sf):
    lines = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("s"))
    return lines.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(T.carries_a_claim(F.col("s"))).alias("n_claims"))


#: Runs of terminators that end sentences, found by position; no look-behind.
@registered(r"""WITH d AS (SELECT doc_id, regexp_replace(text, '\s+$', '') AS t FROM documents),
m AS (SELECT doc_id, regexp_extract_all(t, '[.!?]+["'')\]”’]*\s+[^\s\p{Ll}]') AS hits FROM d)
SELECT doc_id, len(hits)::BIGINT AS n_candidates FROM m""")
def boundary_candidates(spark, sf):
    hits = F.regexp_extract_all(F.regexp_replace("text", r"(?U)\s+$", ""), F.lit(rf"(?U)[.!?]+{T.CLOSERS}*\s+[^\s\p{{Ll}}]"), F.lit(0))
    return documents(spark, sf).select("doc_id", F.size(hits).cast("long").alias("n_candidates"))


@registered()
def sentence_split(spark, sf):
    return T.sentence_table(documents(spark, sf), "doc_id")


@registered()
def chunk_greedy(spark, sf):
    return chunking.chunk_documents(documents(spark, sf))


@registered()
def chunk_hard_split(spark, sf):
    return chunking.chunk_documents(documents(spark, sf), chunking.ChunkingPolicy(8, 0, 12))


PAD = "concat(' ', array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' '), ' ')"
GRAMS = "SELECT {k} AS k, substr(p, i, n) AS g FROM (SELECT {k}, p, n, unnest(range(1, length(p) - n + 2)) AS i FROM (SELECT {k}, {pad} AS p FROM {t}), (VALUES (3), (4), (5)) s(n) WHERE length(p) >= n)"


@registered(f"SELECT k AS item_id, count(*)::BIGINT AS n_grams, round(sum(w), 6) AS weight FROM (SELECT k, g, 1 + ln(count(*)) AS w FROM ({GRAMS.format(k='item_id', pad=PAD, t='benchmark')}) GROUP BY ALL) GROUP BY k")
def ngram_weights(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.explode(R.grams(T.gram_text(F.col("text")))).alias("g"))
    w = b.groupBy("item_id", "g").agg((1 + F.log(F.count(F.lit(1)).cast("double"))).alias("w"))
    return w.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_grams"), F.round(F.sum("w"), 6).alias("weight"))


def embedded(name: str, key: str, source: str, dims: int = 512) -> str:
    return f"""{name}_g AS (SELECT k, g, 1 + ln(count(*)) AS w FROM ({GRAMS.format(k=key, pad=PAD, t=source)}) GROUP BY ALL),
{name}_b AS (SELECT k, concat('0x', substr(md5(g), 1, 8))::BIGINT % {dims} AS b, sum(w) AS w FROM {name}_g GROUP BY ALL),
{name} AS (SELECT k, b, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS w FROM {name}_b)"""


@registered(f"WITH {embedded('e', 'item_id', 'benchmark')} SELECT x.k AS a, y.k AS b, round(sum(x.w * y.w), 5) AS cosine FROM e x JOIN e y USING (b) GROUP BY x.k, y.k".replace("USING (b)", "ON x.b = y.b"))
def ngram_cosine(spark, sf):
    v = R.hashed_grams(table(spark, sf, "benchmark"), "item_id", 512)
    return R.sparse_cosine(v.withColumnRenamed("item_id", "a"), v.withColumnRenamed("item_id", "b"), "a", "b").withColumn("cosine", F.round("cosine", 5))


@registered("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def vector_norm(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.sqrt(R.dot(F.col("embedding"), F.col("embedding"))), 6).alias("norm"))


CENTRES = "c AS (SELECT label, i, avg(x) AS x FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL), n AS (SELECT label, i, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM c), v AS (SELECT vec_id, i, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)), s AS (SELECT label AS qid, vec_id AS chunk_id, sum(n.x * v.x) AS cosine FROM n JOIN v USING (i) GROUP BY ALL)"


def label_questions(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Vectors as chunks, and the mean of each label as a question."""
    e = table(spark, sf, "embeddings")
    centre = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda r: r["x"]).alias("c"))
    return e.select(F.col("vec_id").alias("chunk_id"), R.unit(F.col("embedding").cast("array<double>")).alias("vec")), centre.select(F.col("label").alias("qid"), R.unit(F.col("c")).alias("vec"))


@registered(f"WITH {CENTRES} SELECT qid, chunk_id, round(cosine, 6) AS cosine, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(cosine, 9) DESC, chunk_id) - 1 AS r FROM s) WHERE r < 24")
def cosine_topk(spark, sf):
    near, _ = R.nearest(*label_questions(spark, sf), 24)
    return R.ranked(near, "cosine", 24).select("qid", "chunk_id", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("long").alias("rank"))


DENSE = ", f AS (SELECT qid, avg(cosine) + stddev_pop(cosine) AS fl FROM s GROUP BY qid), dr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(cosine, 9) DESC, chunk_id) - 1 AS r FROM s) "


@registered(f"WITH {CENTRES}{DENSE} SELECT qid, chunk_id, round(cosine, 6) AS score, r AS rank FROM dr JOIN f USING (qid) WHERE r < 24 AND cosine > 0 AND cosine >= fl")
def dense_floor(spark, sf):
    rows = R.dense(*R.nearest(*label_questions(spark, sf), 24), R.RetrievalPolicy())
    return rows.select("qid", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def picks(pool: str, like: str, k: int, diversity: float) -> str:
    """SQL of greedy picks: pool has qid, place, rel, promoted, like has qid, i, j, c. c1 to ck hold the picks so far."""
    out = [f"c1 AS MATERIALIZED (SELECT qid, 0 AS position, 0 AS place FROM {pool} WHERE place = 0)"]
    for n in range(2, k + 1):
        value = f"round({1 - diversity} * any_value(p.rel) - {diversity} * max(coalesce(l.c, 0)) * CASE WHEN any_value(p.promoted) THEN 0.1 ELSE 1 END, 12)"
        out.append(f"c{n} AS MATERIALIZED (SELECT * FROM c{n - 1} UNION ALL SELECT qid, {n - 1}, place FROM (SELECT p.qid, p.place, row_number() OVER (PARTITION BY p.qid ORDER BY {value} DESC, p.place) AS rn FROM {pool} p JOIN c{n - 1} c ON c.qid = p.qid LEFT JOIN {like} l ON l.qid = p.qid AND l.i = p.place AND l.j = c.place WHERE NOT EXISTS (SELECT 1 FROM c{n - 1} x WHERE x.qid = p.qid AND x.place = p.place) GROUP BY p.qid, p.place) WHERE rn = 1)")
    return ", ".join(out)


@registered(f"WITH {CENTRES}, po AS MATERIALIZED (SELECT * FROM (SELECT qid, chunk_id, cosine AS rel, false AS promoted, row_number() OVER (PARTITION BY qid ORDER BY round(cosine, 9) DESC, chunk_id) - 1 AS place FROM s) WHERE place < 24), li AS MATERIALIZED (SELECT a.qid, a.place AS i, b.place AS j, sum(x.x * y.x) AS c FROM po a JOIN po b ON a.qid = b.qid JOIN v x ON x.vec_id = a.chunk_id JOIN v y ON y.vec_id = b.chunk_id AND y.i = x.i GROUP BY ALL), {picks('po', 'li', 6, 0.8)} SELECT po.qid, chunk_id, round(rel, 6) AS score, position::BIGINT AS position FROM c6 JOIN po ON po.qid = c6.qid AND po.place = c6.place")
def mmr_select(spark, sf):
    vectors, asked_ = label_questions(spark, sf)
    near, _ = R.nearest(vectors, asked_, 24)
    pool = R.ranked(near, "cosine", 24).join(vectors.withColumnRenamed("vec", "vector"), "chunk_id")
    rows = R.diversify(pool.select("qid", "chunk_id", F.col("rank").alias("place"), F.col("cosine").alias("relevance"), F.lit(False).alias("promoted"), "vector", F.col("cosine").alias("score")), R.RetrievalPolicy(diversity=0.8))
    return rows.select("qid", "chunk_id", F.round("score", 6).alias("score"), F.col("position").cast("long").alias("position"))


@registered()
def pca_projection(spark, sf):
    return R.project(table(spark, sf, "embeddings"), "vec_id").select("vec_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "explained")


def lexical_and_dense(spark, sf):
    chunks, q = turns(spark, sf), asked(spark, sf)
    a = R.gram_vectors(q.select(F.col("question").alias("text"))).join(q, F.col("text") == F.col("question")).select("qid", "vec")
    b = R.gram_vectors(chunks).join(chunks.select("chunk_id", "text"), "text").select("chunk_id", "vec")
    return chunks, R.bm25(chunks, q), R.dense(*R.nearest(b, a, 24), R.RetrievalPolicy())


TURN_SEARCH = (
    "WITH documents AS (SELECT concat(conv_id, '#', turn) AS doc_id, conv_id, turn, text FROM conversations), "
    + BM25.removeprefix("WITH ")
    + f", {embedded('qe', 'item_id', 'benchmark')}, {embedded('ce', 'doc_id', 'documents')}, cs AS (SELECT qe.k AS qid, ce.k AS chunk_id, sum(qe.w * ce.w) AS cosine FROM qe JOIN ce ON qe.b = ce.b GROUP BY ALL), nn AS (SELECT count(*) AS n FROM documents), "
    + "fl AS (SELECT qid, sum(cosine) / any_value(n) AS mu, sqrt(greatest(sum(cosine * cosine) / any_value(n) - pow(sum(cosine) / any_value(n), 2), 0)) AS sd FROM cs, nn GROUP BY qid), "
    + "dn AS (SELECT qid, chunk_id, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(cosine, 9) DESC, chunk_id) - 1 AS r FROM cs) JOIN fl USING (qid) WHERE r < 24 AND cosine > 0 AND cosine >= mu + sd), "
    + "fu AS (SELECT qid, chunk_id, l.rank AS lexical_rank, dn.rank AS dense_rank, coalesce(1.0::DOUBLE / (61 + l.rank), 0) + coalesce(1.0::DOUBLE / (61 + dn.rank), 0) AS score FROM (SELECT * FROM r WHERE rank < 24) l FULL JOIN dn USING (qid, chunk_id))"
)


@registered(TURN_SEARCH + " SELECT qid, chunk_id, lexical_rank, dense_rank, round(score, 8) AS score FROM fu")
def rrf_fusion(spark, sf):
    _, lexical, vector = lexical_and_dense(spark, sf)
    return R.fuse(lexical, vector).select("qid", "chunk_id", F.col("lexical_rank").cast("long").alias("lexical_rank"), F.col("dense_rank").cast("long").alias("dense_rank"), F.round("score", 8).alias("score"))


@registered(
    TURN_SEARCH
    + """, pl AS (SELECT fu.*, d.conv_id, d.turn FROM fu JOIN documents d ON d.doc_id = fu.chunk_id),
ne AS (SELECT pl.qid, d.doc_id AS chunk_id, max(pl.score * pow(0.82, abs(d.turn - pl.turn))) AS near FROM pl JOIN documents d ON d.conv_id = pl.conv_id AND abs(d.turn - pl.turn) BETWEEN 1 AND 2 GROUP BY ALL)
SELECT qid, chunk_id, round(greatest(coalesce(score, 0), coalesce(near, 0)), 8) AS score, coalesce(near > coalesce(score, 0), false) AS promoted FROM fu FULL JOIN ne USING (qid, chunk_id)"""
)
def neighbor_expand(spark, sf):
    chunks, lexical, vector = lexical_and_dense(spark, sf)
    return R.expand(R.fuse(lexical, vector), chunks, R.RetrievalPolicy()).select("qid", "chunk_id", F.round("score", 8).alias("score"), "promoted")


@registered(
    TURN_SEARCH
    + """, fs AS (SELECT *, coalesce(lexical_rank, dense_rank + 1000000) AS seq FROM fu),
pl AS (SELECT fs.*, d.conv_id, d.turn, row_number() OVER (PARTITION BY qid ORDER BY seq, chunk_id) AS nr FROM fs JOIN documents d ON d.doc_id = fs.chunk_id),
ne AS (SELECT pl.qid, d.doc_id AS chunk_id, max(pl.score * pow(0.82, abs(d.turn - pl.turn))) AS near, min(2000000 + nr * 100 + abs(d.turn - pl.turn) * 2 + CASE WHEN d.turn > pl.turn THEN 1 ELSE 0 END) AS by_ FROM pl JOIN documents d ON d.conv_id = pl.conv_id AND abs(d.turn - pl.turn) BETWEEN 1 AND 2 GROUP BY ALL),
xp AS (SELECT qid, chunk_id, greatest(coalesce(score, 0), coalesce(near, 0)) AS score, lexical_rank, dense_rank, coalesce(seq, by_) AS seq, coalesce(near > coalesce(score, 0), false) AS promoted FROM fs FULL JOIN ne USING (qid, chunk_id)),
po AS MATERIALIZED (SELECT xp.*, coalesce(cs.cosine, 0) AS rel FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, seq, chunk_id) - 1 AS place FROM xp) xp LEFT JOIN cs ON cs.qid = xp.qid AND cs.chunk_id = xp.chunk_id WHERE place < 24),
li AS MATERIALIZED (SELECT a.qid, a.place AS i, b.place AS j, sum(x.w * y.w) AS c FROM po a JOIN po b ON a.qid = b.qid JOIN ce x ON x.k = a.chunk_id JOIN ce y ON y.k = b.chunk_id AND y.b = x.b GROUP BY ALL), """
    + picks("po", "li", 6, 0.35)
    + " SELECT po.qid, position::BIGINT AS position, po.chunk_id, round(score, 8) AS score, lexical_rank, dense_rank FROM c6 JOIN po ON po.qid = c6.qid AND po.place = c6.place"
)
def hybrid_search(spark, sf):
    found = R.search(turns(spark, sf), asked(spark, sf), R.embedder("ngram-md5"))
    return found.select("qid", F.col("position").cast("long").alias("position"), "chunk_id", F.round("score", 8).alias("score"), F.col("lexical_rank").cast("long").alias("lexical_rank"), F.col("dense_rank").cast("long").alias("dense_rank"))


def retrieved(spark, sf) -> DataFrame:
    """Turns of a conversation as what its question retrieved."""
    return turns(spark, sf).select(F.col("doc_id").alias("qid"), F.col("ordinal").cast("int").alias("position"), "chunk_id", "text")


PLAN = """WITH t AS (SELECT conv_id AS qid, turn, concat(conv_id, '#', turn) AS c, text FROM conversations), ids AS (SELECT qid, list(c ORDER BY turn) AS ids FROM t GROUP BY qid),
p AS (SELECT qid, 0 AS o, 'closed' AS run_id, 'closed' AS kind, ids AS removed FROM ids UNION ALL SELECT qid, 1, 'control-0', 'control', [] FROM ids WHERE len(ids) > 1
UNION ALL SELECT qid, 2 + row_number() OVER (PARTITION BY qid ORDER BY turn), concat('loo-', c), 'loo', [c] FROM t),
plan AS MATERIALIZED (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY o) - 1 AS run_seq, run_id, kind, removed, count(*) OVER (PARTITION BY qid) > {b} AS truncated FROM p)"""


@registered(PLAN.format(b=27) + " SELECT qid, run_seq, run_id, kind, array_to_string(removed, ',') AS removed, truncated FROM plan WHERE run_seq < 27")
def run_plan(spark, sf):
    return X.base_plan(retrieved(spark, sf), X.AblationPolicy()).select("qid", F.col("run_seq").cast("long").alias("run_seq"), "run_id", "kind", F.array_join("removed", ",").alias("removed"), "truncated")


@registered(PLAN.format(b=3) + " SELECT qid, run_seq, run_id, truncated FROM plan WHERE run_seq < 3")
def budget_truncate(spark, sf):
    return X.base_plan(retrieved(spark, sf), X.AblationPolicy(max_runs=4)).select("qid", F.col("run_seq").cast("long").alias("run_seq"), "run_id", "truncated")


VISIBLE = PLAN.format(b=27) + ", v AS (SELECT qid, run_seq, run_id, kind, ids, removed, CASE WHEN kind = 'control' THEN list_concat(list_slice(ids, len(ids) // 2 + 1, len(ids)), list_slice(ids, 1, len(ids) // 2)) ELSE list_filter(ids, lambda c: NOT list_contains(removed, c)) END AS shown FROM plan JOIN ids USING (qid) WHERE run_seq < 27)"


@registered(VISIBLE + " SELECT qid, run_id, array_to_string(shown, ',') AS shown FROM v")
def visible_sets(spark, sf):
    r = retrieved(spark, sf)
    return X.visible(X.base_plan(r, X.AblationPolicy()), r).select("qid", "run_id", F.array_join("shown", ",").alias("shown"))


def prompted(spark, sf) -> DataFrame:
    r = retrieved(spark, sf)
    q = r.select("qid").distinct().withColumn("question", F.concat(F.lit("What of "), F.col("qid").cast("string"), F.lit("?")))
    return X.requests(X.visible(X.base_plan(r, X.AblationPolicy()), r), q)


PROMPT = VISIBLE + r""", x AS (SELECT v.qid, run_id, s, i FROM v, unnest(shown) WITH ORDINALITY AS u(s, i)),
pr AS (SELECT v.qid, v.run_id, CASE WHEN len(shown) = 0 THEN concat('What of ', v.qid, '?') ELSE concat('Excerpts:', chr(10), chr(10), (SELECT string_agg(concat('[', x.i, '] ', regexp_replace(regexp_replace(t.text, '^\s+', ''), '\s+$', ''), chr(10), chr(10)), '' ORDER BY x.i) FROM x JOIN t ON t.c = x.s WHERE x.qid = v.qid AND x.run_id = v.run_id), 'Question: What of ', v.qid, '?') END AS prompt FROM v)"""


@registered(PROMPT + " SELECT qid, run_id, sha256(prompt) AS prompt_sha FROM pr")
def prompts(spark, sf):
    return prompted(spark, sf).select("qid", "run_id", F.sha2("prompt", 256).alias("prompt_sha"))


RULES = [(0, " the ", "It names the thing."), (1, "tion", "It states a relation."), (2, "que", "It is said elsewhere."), (3, "ö", "It was heard there.")]


@registered(PROMPT + ", a AS (SELECT qid, run_id, length(prompt) // 4 AS input_tokens, concat_ws(' ', " + ", ".join(f"CASE WHEN contains(prompt, '{t}') THEN '{s}' END" for _, t, s in RULES) + ") AS answer FROM pr) SELECT qid, run_id, input_tokens, CASE WHEN answer = '' THEN 'I do not know.' ELSE answer END AS answer FROM a")
def scripted_generate(spark, sf):
    p = prompted(spark, sf)
    rules = spark.createDataFrame(RULES, "rule_ord int, trigger string, sentence string")
    answers = X.scripted(p, rules)
    return X.replay(p.select("qid", "run_id", "request_key"), answers).select("qid", "run_id", "input_tokens", "answer")


@registered("SELECT conv_id, role, round((sum(length(text) // 4) * 1.0 + sum(40) * 5.0) / 1e6, 8) AS cost FROM conversations GROUP BY ALL")
def usage_cost(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id", "role").agg(F.sum(F.floor(F.length("text") / 4)).alias("i"), (F.count(F.lit(1)) * 40).alias("o"))
    return c.select("conv_id", "role", F.round(X.price(F.lit("claude-haiku-4-5-x"), F.col("i"), F.col("o")), 8).alias("cost"))


LINES = "ln AS (SELECT conv_id, turn, i, s AS text, concat(conv_id, '#', turn, '#', i) AS k FROM conversations, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(s, i))"


@registered(f"WITH {LINES}, {embedded('e', 'k', 'ln', 1024)}, sm AS (SELECT a.k AS ka, b.k AS kb, sum(a.w * b.w) AS c FROM e a JOIN ln la ON la.k = a.k AND la.turn = 1 JOIN e b ON a.b = b.b JOIN ln lb ON lb.k = b.k AND lb.conv_id = la.conv_id AND lb.turn <> 1 GROUP BY ALL), g AS (SELECT DISTINCT l.conv_id, l.i, l.k, o.turn FROM ln l JOIN ln o ON o.conv_id = l.conv_id AND o.turn <> 1 WHERE l.turn = 1) SELECT g.conv_id AS qid, g.i - 1 AS claim_idx, g.turn::VARCHAR AS run_id, round(least(greatest(coalesce(max(c), 0), 0), 1), 5) AS survival FROM g LEFT JOIN (SELECT sm.*, ln.turn FROM sm JOIN ln ON ln.k = kb) sm ON sm.ka = g.k AND sm.turn = g.turn GROUP BY ALL")
def survival_matrix(spark, sf):
    lines = F.transform(F.split(F.translate("text", "İ", "i"), "\n"), T.gram_text)  # Spark lowers İ to i and a dot, which would end the word
    said = turns(spark, sf).filter("text is not null").select(F.col("doc_id").alias("qid"), F.col("ordinal").alias("turn"), lines.alias("lines"))
    claims, runs = (said.filter(which).groupBy("qid", "turn").agg(F.collect_list("lines").alias("copies")) for which in ("turn = 1", "turn <> 1"))
    alive = X.gram_survival(claims.select("qid", "copies"), runs.select("qid", F.col("turn").cast("string").alias("run_id"), "copies"), 1024)
    return alive.select("qid", F.col("claim_idx").cast("long").alias("claim_idx"), "run_id", F.round("survival", 5).alias("survival"))


def scored_runs(spark, sf) -> DataFrame:
    """Three claims for each conversation with a fixed survival in each of its base runs."""
    r = retrieved(spark, sf)
    runs = X.base_plan(r, X.AblationPolicy()).withColumn("claim_idx", F.explode(F.array(*map(F.lit, range(3)))))
    s = F.pow(fraction("qid", "claim_idx", "run_id"), F.lit(0.15))
    return runs.select("qid", "claim_idx", (fraction("qid", "claim_idx") > 0.1).alias("checkable"), "kind", F.get("removed", F.lit(0)).alias("chunk_id"), F.col("run_seq").alias("position"), s.alias("survival"))


SCORED = PLAN.format(b=27) + f""", sr AS (SELECT qid, claim_idx, {FRACTION.format("concat_ws('/', qid, claim_idx)")} > 0.1 AS checkable, kind, run_seq, removed[1] AS chunk_id, pow({FRACTION.format("concat_ws('/', qid, claim_idx, run_id)")}, 0.15) AS s FROM plan, (VALUES (0), (1), (2)) c(claim_idx) WHERE run_seq < 27),
nm AS (SELECT qid, claim_idx, checkable, least(greatest(coalesce(median(1 - s) FILTER (kind = 'control'), 0), 0), 0.9) AS noise, coalesce(max(s) FILTER (kind = 'closed'), 0) AS memory FROM sr GROUP BY ALL),
ef AS (SELECT sr.qid, sr.claim_idx, chunk_id, run_seq, greatest(0, 1 - s - noise) AS effect FROM sr JOIN nm USING (qid, claim_idx) WHERE kind = 'loo'),
vd AS (SELECT nm.*, coalesce(b.best, 0) AS best, CASE WHEN NOT checkable THEN 'no_claim' WHEN coalesce(b.best, 0) >= 0.12 THEN 'grounded' WHEN memory >= 0.78 THEN 'model_memory' ELSE 'undetermined' END AS verdict FROM nm LEFT JOIN (SELECT qid, claim_idx, max(effect) AS best FROM ef GROUP BY ALL) b USING (qid, claim_idx))"""


@registered(SCORED + " SELECT vd.qid, vd.claim_idx::BIGINT AS claim_idx, verdict, round(noise, 6) AS noise, round(memory, 6) AS memory, round(best, 6) AS best, coalesce((SELECT string_agg(chunk_id, ',' ORDER BY effect DESC, run_seq) FROM ef WHERE ef.qid = vd.qid AND ef.claim_idx = vd.claim_idx AND verdict = 'grounded' AND effect >= greatest(0.12, 0.6 * best)), '') AS credited FROM vd")
def verdicts(spark, sf):
    v = X.first_pass(scored_runs(spark, sf), X.AblationPolicy())
    credited = F.array_join(F.transform(F.filter("support", lambda s: s["credited"]), lambda s: s["chunk_id"]), ",")
    return v.select("qid", F.col("claim_idx").cast("long").alias("claim_idx"), "verdict", F.round("noise", 6).alias("noise"), F.round("memory", 6).alias("memory"), F.round("best", 6).alias("best"), credited.alias("credited"))


@registered(SCORED + " SELECT qid, count_if(verdict = 'grounded')::BIGINT AS grounded, count_if(verdict <> 'no_claim')::BIGINT AS checkable, bool_or(verdict = 'grounded') AS corpus_contributed FROM vd GROUP BY qid")
def report_summary(spark, sf):
    return X.summary(X.settle(X.first_pass(scored_runs(spark, sf), X.AblationPolicy()), F.lit(False)))


RANKED = f"rk AS (SELECT qid, claim_idx, c, row_number() OVER (PARTITION BY qid, claim_idx ORDER BY {FRACTION.format('concat_ws(chr(47), qid, claim_idx, c)')} DESC, c) - 1 AS r FROM t, (VALUES (0), (1), (2)) c(claim_idx))"
COALITIONS = PLAN.format(b=27) + f", {RANKED}, tr AS (SELECT qid, claim_idx, max(c) FILTER (r = 0) AS a, max(c) FILTER (r = 1) AS b, max(c) FILTER (r = 2) AS d FROM rk WHERE r < 3 GROUP BY ALL), gs AS (SELECT qid, claim_idx, 0 AS j, list_sort([a, b]) AS g FROM tr WHERE b IS NOT NULL UNION ALL SELECT qid, claim_idx, 1, list_sort([a, d]) FROM tr WHERE d IS NOT NULL UNION ALL SELECT qid, claim_idx, 2, list_sort([b, d]) FROM tr WHERE d IS NOT NULL UNION ALL SELECT qid, claim_idx, 3, list_sort([a, b, d]) FROM tr WHERE d IS NOT NULL), gd AS (SELECT qid, g, min(claim_idx * 10 + j) AS seen FROM gs GROUP BY ALL), cp AS (SELECT qid, g, row_number() OVER (PARTITION BY qid ORDER BY len(g), seen) - 1 AS i FROM gd)"


def coalition_runs(spark, sf) -> DataFrame:
    order = Window.partitionBy("qid", "claim_idx").orderBy(F.desc(fraction("qid", "claim_idx", "chunk_id")), "chunk_id")
    ranked = retrieved(spark, sf).withColumn("claim_idx", F.explode(F.array(*map(F.lit, range(3))))).withColumn("rank", F.row_number().over(order) - 1)
    return X.coalition_plan(ranked, X.AblationPolicy())


@registered(COALITIONS + " SELECT qid, concat('coalition-', i) AS run_id, array_to_string(g, ',') AS removed FROM cp")
def coalition_groups(spark, sf):
    return coalition_runs(spark, sf).select("qid", "run_id", F.array_join("removed", ",").alias("removed"))


@registered(COALITIONS + ", " + SCORED.split("), sr AS")[0][:0] + "sr AS" + SCORED.split(", sr AS", 1)[1] + f", cs AS (SELECT vd.qid, claim_idx, i, g, greatest(0, 1 - pow({FRACTION.format('concat_ws(chr(47), vd.qid, claim_idx, concat(chr(99), i))')}, 0.15) - noise) AS effect FROM vd JOIN cp ON cp.qid = vd.qid WHERE verdict = 'undetermined'), bs AS (SELECT qid, claim_idx, max(effect) AS effect, arg_max(g, (effect, -i)) AS g FROM cs GROUP BY ALL HAVING max(effect) >= 0.12) SELECT vd.qid, vd.claim_idx::BIGINT AS claim_idx, CASE WHEN bs.effect IS NOT NULL THEN 'grounded' WHEN verdict = 'undetermined' THEN 'unsupported' ELSE verdict END AS verdict, coalesce(array_to_string(bs.g, ','), '') AS members FROM vd LEFT JOIN bs ON bs.qid = vd.qid AND bs.claim_idx = vd.claim_idx")
def coalition_verdicts(spark, sf):
    runs = coalition_runs(spark, sf).withColumn("run_seq", F.substring_index("run_id", "-", -1).cast("int"))
    scores = runs.withColumn("claim_idx", F.explode(F.array(*map(F.lit, range(3))))).withColumn("survival", F.pow(fraction("qid", "claim_idx", F.concat(F.lit("c"), F.col("run_seq").cast("string"))), F.lit(0.15)))
    out = X.settle(X.coalition_pass(X.first_pass(scored_runs(spark, sf), X.AblationPolicy()), scores, X.AblationPolicy()), F.lit(False))
    return out.select("qid", F.col("claim_idx").cast("long").alias("claim_idx"), "verdict", F.coalesce(F.array_join("members", ","), F.lit("")).alias("members"))


RATES = "count_if(e AND p)::BIGINT AS tp, count_if(NOT e AND p)::BIGINT AS fp, count_if(e AND NOT p)::BIGINT AS fn, count_if(NOT e AND NOT p)::BIGINT AS tn"
RATIOS = "round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall, round(coalesce(fp / nullif(fp + tn, 0), 0), 4) AS fpr, round(1 - coalesce(tp / nullif(tp + fn, 0), 0), 4) AS fnr"


@registered(f"SELECT *, {RATIOS} FROM (SELECT {RATES} FROM (SELECT quality = 1 AS e, toxic = 0 AS p FROM labels))")
def confusion_matrix(spark, sf):
    return X.confusion(table(spark, sf, "labels").select((F.col("quality") == 1).alias("expected"), (F.col("toxic") == 0).alias("predicted")))


@registered(f"WITH s AS (SELECT quality = 1 AS e, th, {FRACTION.format('doc_id::VARCHAR')} * 0.4 * (0.5 + quality) >= th AS p FROM labels, (VALUES (0.06), (0.09), (0.12), (0.15), (0.20), (0.25)) t(th)), c AS (SELECT th, {RATES} FROM s GROUP BY th), r AS (SELECT th::DOUBLE AS threshold, tp, fp, fn, tn, {RATIOS} FROM c) SELECT *, row_number() OVER (ORDER BY (fpr > 0.1)::INT, recall DESC, precision DESC, threshold) = 1 AS best FROM r")
def threshold_sweep(spark, sf):
    l = table(spark, sf, "labels")
    return X.threshold_sweep(l.select((F.col("quality") == 1).alias("expected"), (fraction(F.col("doc_id").cast("string")) * 0.4 * (0.5 + F.col("quality"))).alias("score")))


#: Sentences that scripted answers and labels consist of.
FALLBACK, NEVER = "I do not know.", "Nothing of this was ever said."
TRIGGERS = ", ".join(f"CASE WHEN contains(prompt, '{t}') THEN '{s}' END" for _, t, s in RULES)
STRIPPED = r"regexp_replace(regexp_replace(t.text, '^\s+', ''), '\s+$', '')"


def answered(src: str, out: str) -> str:
    """SQL of the answers' sentences to the runs of src (qid, run_seq, run_id, kind, removed)."""
    return f"""{out}v AS (SELECT r.*, CASE WHEN kind = 'control' THEN list_concat(list_slice(ids, len(ids) // 2 + 1, len(ids)), list_slice(ids, 1, len(ids) // 2)) ELSE list_filter(ids, lambda c: NOT list_contains(removed, c)) END AS shown FROM {src} r JOIN ids USING (qid)),
{out}x AS (SELECT qid, run_id, s, i FROM {out}v, unnest(shown) WITH ORDINALITY AS u(s, i)),
{out}t AS (SELECT x.qid, x.run_id, string_agg(concat('[', i, '] ', {STRIPPED}, chr(10), chr(10)), '' ORDER BY i) AS txt FROM {out}x x JOIN t ON t.c = x.s GROUP BY ALL),
{out}p AS (SELECT v.*, CASE WHEN len(shown) = 0 THEN concat('What of ', v.qid, '?') ELSE concat('Excerpts:', chr(10), chr(10), txt, 'Question: What of ', v.qid, '?') END AS prompt FROM {out}v v LEFT JOIN {out}t x ON x.qid = v.qid AND x.run_id = v.run_id),
{out} AS MATERIALIZED (SELECT qid, run_seq, run_id, kind, removed, CASE WHEN len(l) = 0 THEN ['{FALLBACK}'] ELSE l END AS sents FROM (SELECT *, list_filter([{TRIGGERS}], lambda s: s IS NOT NULL) AS l FROM {out}p))"""


def survived(claims: str, runs: str, out: str) -> str:
    return f"{out} AS MATERIALIZED (SELECT c.qid, c.claim_idx, c.checkable, a.run_id, a.kind, a.run_seq, a.removed, least(1, greatest(0, coalesce(max(ss.c), 0))) AS s FROM {claims} c JOIN (SELECT *, unnest(sents) AS said FROM {runs} WHERE kind <> 'full') a ON a.qid = c.qid LEFT JOIN ss ON ss.a = c.s AND ss.b = a.said GROUP BY ALL)"


def likeness(a: str, b: str) -> str:
    """SQL of the largest cosine in both sizes of vectors."""
    each = " UNION ALL ".join(f"SELECT x.k AS a, y.k AS b, sum(x.w * y.w) AS c FROM {a}{i} x JOIN {b}{i} y ON x.b = y.b GROUP BY ALL" for i in (1, 2))
    return f"(SELECT a, b, max(c) AS c FROM ({each}) GROUP BY ALL)"


SENTENCES = ", ".join(f"('{s}')" for s in (*(s for _, _, s in RULES), FALLBACK, NEVER))
JUDGED = "nm AS " + SCORED.split("nm AS ", 1)[1]
ASKED = (
    PLAN.format(b=27)
    + ", pl AS (SELECT qid, run_seq, run_id, kind, removed FROM plan WHERE run_seq < 27 UNION ALL SELECT qid, -1, 'full', 'full', [] FROM ids), "
    + answered("pl", "a0")
    + f", st(text) AS (VALUES {SENTENCES}), "
    + ", ".join(embedded(f"{n}{i}", k, t, d) for i, d in ((1, 512), (2, 1024)) for n, k, t in (("s", "text", "st"), ("w", "c", "t")))
    + f", ss AS MATERIALIZED {likeness('s', 's')}, cl AS (SELECT qid, i - 1 AS claim_idx, s, s <> '{FALLBACK}' AS checkable FROM a0, unnest(sents) WITH ORDINALITY AS u(s, i) WHERE kind = 'full'), "
    + survived("cl", "a0", "sv")
    + ", sr AS (SELECT qid, claim_idx, checkable, kind, run_seq, removed[1] AS chunk_id, s FROM sv), "
    + JUDGED
)
JOINED = (
    ASKED
    + f", un AS (SELECT vd.qid, vd.claim_idx, cl.s FROM vd JOIN cl USING (qid, claim_idx) WHERE verdict = 'undetermined'), lk AS MATERIALIZED {likeness('s', 'w')}, rk AS (SELECT un.qid, un.claim_idx, t.c, row_number() OVER (PARTITION BY un.qid, un.claim_idx ORDER BY round(coalesce(lk.c, 0), 9) DESC, t.turn) - 1 AS r FROM un JOIN t ON t.qid = un.qid LEFT JOIN lk ON lk.a = un.s AND lk.b = t.c), tr AS "
    + COALITIONS.split(", tr AS ", 1)[1]
    + ", ud AS (SELECT qid, count(*) AS used, bool_or(truncated) AS cut FROM plan WHERE run_seq < 27 GROUP BY qid), co AS (SELECT cp.qid, used + i AS run_seq, concat('coalition-', i) AS run_id, 'coalition' AS kind, g AS removed FROM cp JOIN ud USING (qid) WHERE i < 27 - used), "
    + answered("co", "a1")
    + ", "
    + survived("cl", "a1", "js")
    + ", bs AS (SELECT qid, claim_idx, max(effect) AS effect, arg_max(g, (effect, -run_seq)) AS g FROM (SELECT js.qid, js.claim_idx, js.removed AS g, js.run_seq, greatest(0, 1 - js.s - vd.noise) AS effect FROM js JOIN vd USING (qid, claim_idx) WHERE verdict = 'undetermined') GROUP BY ALL HAVING max(effect) >= 0.12), "
    + "en AS (SELECT ud.qid, cut OR coalesce(bool_or(cp.i >= 27 - used), false) AS truncated FROM ud LEFT JOIN cp ON cp.qid = ud.qid GROUP BY ud.qid, cut), "
    + "fv AS (SELECT vd.qid, vd.claim_idx, cl.s AS text, noise, memory, CASE WHEN bs.effect IS NOT NULL THEN 'grounded' WHEN verdict = 'undetermined' AND NOT truncated THEN 'unsupported' ELSE verdict END AS verdict, CASE WHEN bs.effect IS NOT NULL THEN list_sort(bs.g) WHEN verdict = 'grounded' THEN (SELECT list_sort(list(chunk_id)) FROM ef WHERE ef.qid = vd.qid AND ef.claim_idx = vd.claim_idx AND effect >= greatest(0.12, 0.6 * best)) ELSE [] END AS credited FROM vd JOIN cl ON cl.qid = vd.qid AND cl.claim_idx = vd.claim_idx JOIN en ON en.qid = vd.qid LEFT JOIN bs ON bs.qid = vd.qid AND bs.claim_idx = vd.claim_idx)"
)
_ANALYSES: dict = {}
MODEL = "claude-haiku-4-5"


def embedders() -> list:
    return [R.embedder("ngram-md5", 512), R.embedder("ngram-md5", 1024)]


def scripted(spark):
    rules = spark.createDataFrame(RULES, "rule_ord int, trigger string, sentence string")
    return lambda rows: X.scripted(rows, rules, FALLBACK)


def analysis(spark, sf) -> A.Analysis:
    """Every conversation is a question whose turns it has retrieved; one analysis for each application and folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _ANALYSES:
        r = retrieved(spark, sf)
        q = r.select("qid").distinct().withColumn("question", F.concat(F.lit("What of "), F.col("qid").cast("string"), F.lit("?")))
        _ANALYSES[key] = A.ask(q, r, scripted(spark), embedders(), model=MODEL)
    return _ANALYSES[key]


def places(spark, sf) -> DataFrame:
    """Each turn is a document of its own, named like its chunk."""
    return retrieved(spark, sf).select("chunk_id", F.col("chunk_id").alias("doc_id"), "text")


@registered(JOINED + " SELECT qid, claim_idx::BIGINT AS claim_idx, text, verdict, round(noise, 6) AS noise, round(memory, 6) AS memory, array_to_string(credited, ',') AS credited FROM fv")
def ask_verdicts(spark, sf):
    c = analysis(spark, sf).claims
    credited = F.array_join(F.array_sort(F.transform(F.filter("support", lambda s: s["credited"]), lambda s: s["chunk_id"])), ",")
    return c.select("qid", F.col("claim_idx").cast("long").alias("claim_idx"), "text", "verdict", F.round("noise", 6).alias("noise"), F.round("memory", 6).alias("memory"), credited.alias("credited"))


@registered(JOINED + ", ar AS (SELECT qid, run_seq, run_id, removed, sents FROM a0 UNION ALL SELECT qid, run_seq, run_id, removed, sents FROM a1) SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY starts_with(run_id, 'coalition'), run_seq) - 1 AS run_seq, run_id, array_to_string(removed, ',') AS removed, array_to_string(sents, ' ') AS answer FROM ar")
def ask_runs(spark, sf):
    r = analysis(spark, sf).runs
    return r.select("qid", F.col("run_seq").cast("long").alias("run_seq"), "run_id", F.array_join("removed", ",").alias("removed"), "answer")


ALL_RUNS = ", ar AS (SELECT qid, run_id, kind, length(prompt) // 4 AS i FROM a0p UNION ALL SELECT qid, run_id, kind, length(prompt) // 4 FROM a1p)"


@registered(JOINED + ALL_RUNS + ", us AS (SELECT qid, count(*) AS runs, sum(i)::BIGINT AS input_tokens, count(*) * 40 AS output_tokens FROM ar GROUP BY qid) SELECT us.qid, coalesce(count_if(verdict = 'grounded'), 0)::BIGINT AS grounded, count_if(verdict <> 'no_claim')::BIGINT AS checkable, bool_or(verdict = 'grounded') AS corpus_contributed, runs, input_tokens, output_tokens, round((input_tokens + output_tokens * 5) / 1e6, 6) AS cost_usd, truncated FROM us JOIN fv USING (qid) JOIN en USING (qid) GROUP BY us.qid, runs, input_tokens, output_tokens, truncated")
def ask_summaries(spark, sf):
    return report.summaries(analysis(spark, sf)).drop("cached")


@registered(JOINED + ALL_RUNS + ", ev AS (SELECT qid, unnest([0, 1, 3, 5, 6, 7, 8]) AS o, unnest(['question', 'retrieved', 'answer', 'verdicts', 'done', 'report', 'complete']) AS type FROM ids UNION ALL SELECT qid, 4, 'run' FROM ar WHERE kind <> 'full') SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY o) - 1 AS seq, type FROM ev")
def event_order(spark, sf):
    a = analysis(spark, sf)
    return E.log(a, report.reports(a)).select("qid", F.col("seq").cast("long").alias("seq"), "type")


@registered(JOINED + ", pb AS (SELECT qid, ids[1] AS doc FROM ids) SELECT pb.qid, coalesce(list_contains(list_distinct(flatten(list(credited) FILTER (verdict = 'grounded'))), doc), false) AS passed FROM pb LEFT JOIN fv ON fv.qid = pb.qid GROUP BY pb.qid, doc")
def attribution_suite(spark, sf):
    """Is the first turn among the documents that grounded claims credit?"""
    r = retrieved(spark, sf)
    probes = r.groupBy("qid").agg(F.min_by("chunk_id", "position").alias("expected_doc"))
    return X.attribution(analysis(spark, sf).claims, probes, places(spark, sf)).select("qid", "passed")


LABELS = f"lb AS (SELECT qid, bool_or(contains(text, 'que')) AS expected, '{RULES[2][2]}' AS s FROM t GROUP BY qid UNION ALL SELECT qid, false, '{NEVER}' FROM ids), ck AS (SELECT DISTINCT qid FROM fv WHERE verdict <> 'no_claim'), ll AS (SELECT lb.qid, row_number() OVER (PARTITION BY lb.qid ORDER BY s) - 1 AS claim_idx, s, expected, true AS checkable FROM lb JOIN ck USING (qid)), " + survived("ll", "a0", "lv") + ", " + re.sub(r"\b(nm|ef|vd|sr)\b", r"l\1", "sr AS (SELECT qid, claim_idx, checkable, kind, run_seq, removed[1] AS chunk_id, s FROM lv), " + JUDGED)


def label_rows(spark, sf) -> DataFrame:
    t = retrieved(spark, sf)
    one = t.groupBy("qid").agg(F.bool_or(F.contains("text", F.lit("que"))).alias("expected")).withColumn("sentence", F.lit(RULES[2][2]))
    return one.unionByName(t.select("qid").distinct().withColumn("expected", F.lit(False)).withColumn("sentence", F.lit(NEVER)))


@registered(JOINED + ", " + LABELS + " SELECT lb.qid, lb.s AS sentence, lb.expected, coalesce(CASE WHEN verdict = 'undetermined' THEN 'unsupported' ELSE verdict END, 'skipped') AS verdict FROM lb LEFT JOIN ll ON ll.qid = lb.qid AND ll.s = lb.s LEFT JOIN lvd ON lvd.qid = ll.qid AND lvd.claim_idx = ll.claim_idx")
def injection_suite(spark, sf):
    rows = A.injection(analysis(spark, sf), label_rows(spark, sf), embedders())
    return rows.select("qid", "sentence", "expected", F.coalesce("verdict", F.lit("skipped")).alias("verdict"))


@registered(JOINED + ", " + LABELS + f", th(th) AS (VALUES (0.06), (0.09), (0.12), (0.15), (0.20), (0.25)), pr AS (SELECT th::DOUBLE AS threshold, expected AS e, checkable AND best >= th AS p FROM (SELECT lvd.*, ll.expected FROM lvd JOIN ll USING (qid, claim_idx)), th), ct AS (SELECT threshold, {RATES} FROM pr GROUP BY threshold), rt AS (SELECT threshold, tp, fp, fn, tn, {RATIOS} FROM ct) SELECT *, row_number() OVER (ORDER BY (fpr > 0.1)::INT, recall DESC, precision DESC, threshold) = 1 AS best FROM rt")
def threshold_sweep_labels(spark, sf):
    return A.sweep(analysis(spark, sf), label_rows(spark, sf), embedders())


@registered(
    JOINED
    + ", cr AS (SELECT qid, claim_idx, text, credited, len(credited) >= (SELECT count(*) FROM t) AS whole FROM fv WHERE verdict = 'grounded'), va AS (SELECT DISTINCT qid, credited AS removed, 0 AS run_seq, array_to_string(credited, ',') AS run_id, 'again' AS kind FROM cr WHERE NOT whole), "
    + answered("va", "a2")
    + ", cs AS (SELECT cr.qid, cr.claim_idx, least(1, greatest(0, max(ss.c))) AS s FROM cr JOIN (SELECT *, unnest(sents) AS said FROM a2) a ON a.qid = cr.qid AND a.run_id = array_to_string(cr.credited, ',') LEFT JOIN ss ON ss.a = cr.text AND ss.b = a.said GROUP BY ALL) SELECT cr.qid, cr.claim_idx::BIGINT AS claim_idx, array_to_string(credited, ',') AS removed_docs, round(coalesce(cs.s, 0), 5) AS survival, coalesce(cs.s, 0) < 0.85 AS passed FROM cr LEFT JOIN cs USING (qid, claim_idx)"
)
def counterfactual_suite(spark, sf):
    """Every grounded claim is asked again from the turns that are left without the credited ones."""
    r = retrieved(spark, sf)

    def search(questions: DataFrame, removed: DataFrame) -> DataFrame:
        own = r.withColumnRenamed("qid", "conv").join(questions.withColumn("conv", F.substring_index("qid", "/", 1).cast("long")), "conv").select("qid", "position", "chunk_id", "text")
        return own.join(removed.withColumnRenamed("doc_id", "chunk_id"), ["qid", "chunk_id"], "left_anti")

    out = A.without_credited(analysis(spark, sf), places(spark, sf), search, scripted(spark), embedders())
    return out.select("qid", F.col("claim_idx").cast("long").alias("claim_idx"), F.array_join("removed_docs", ",").alias("removed_docs"), F.round("survival", 5).alias("survival"), "passed")


FOLD = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"


@registered(f"SELECT item_id, count(doc_id)::BIGINT AS n_docs, count(doc_id) = 1 AS is_unique FROM benchmark b LEFT JOIN documents d ON contains({FOLD.format('d.text')}, {FOLD.format('b.text')}) GROUP BY item_id")
def probe_uniqueness(spark, sf):
    """Phrases, whole, are the small side of a substring join, so documents are read once and never shuffled."""
    phrases = table(spark, sf, "benchmark").select("item_id", T.folded(F.col("text")).alias("phrase"))
    docs = documents(spark, sf).select("doc_id", T.folded(F.col("text")).alias("t"))
    hits = docs.join(F.broadcast(phrases), F.contains("t", "phrase")).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return phrases.join(hits, "item_id", "left").select("item_id", n.alias("n_docs"), (n == 1).alias("is_unique"))


@registered("SELECT sha256(text) AS doc_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT concat('document titled ', source))), ', ') AS places FROM documents GROUP BY sha256(text) HAVING count(*) > 1")
def duplicate_documents(spark, sf):
    d = documents(spark, sf).select(F.sha2("text", 256).alias("doc_id"), F.col("source").alias("title"), F.create_map().cast("map<string,string>").alias("meta"))
    return corpus.duplicate_ids(d).withColumn("places", F.array_join("places", ", "))


@registered("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value, arg_max(props, event_id) AS props FROM events GROUP BY ALL")
def event_fold_latest(spark, sf):
    return E.latest(table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "props"), "user_id", "event_type")


@registered("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_meters(spark, sf):
    return E.meters(table(spark, sf, "events"), "event_type").withColumn("total", F.round("total", 4))


@registered("SELECT event_id, concat('event: ', event_type, chr(10), 'data: ', props, chr(10), chr(10)) AS frame FROM events")
def event_frames(spark, sf):
    return table(spark, sf, "events").select("event_id", E.sse(F.col("event_type"), F.col("props")).alias("frame"))


@registered(f"SELECT conv_id AS qid, turn AS claim_idx, " + ", ".join(f"max(least(1.0, greatest(0.0, {FRACTION.format('concat_ws(chr(47), conv_id, turn)')} / 0.6))) FILTER (role = '{r}') AS \"{r}\"" for r in ("assistant", "system", "user")) + " FROM conversations GROUP BY ALL")
def effect_heatmap(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("qid"), F.col("turn").alias("claim_idx"), F.col("role").alias("chunk_id"), fraction("conv_id", "turn").alias("effect"))
    return E.heatmap(c, ["assistant", "system", "user"])


@registered("SELECT event_id, round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()), 8) AS value FROM events")
def rescale_minmax(spark, sf):
    return E.rescale(table(spark, sf, "events").select("event_id", "value"), "value").withColumn("value", F.round("value", 8))


@registered(TURN_SEARCH + " SELECT qid, chunk_id, concat_ws('+', CASE WHEN lexical_rank IS NOT NULL THEN 'keyword' END, CASE WHEN dense_rank IS NOT NULL THEN 'vector' END) AS tags FROM fu")
def provenance_tags(spark, sf):
    _, lexical, vector = lexical_and_dense(spark, sf)
    return R.fuse(lexical, vector).select("qid", "chunk_id", F.array_join(E.provenance(F.col("lexical_rank"), F.col("dense_rank")), "+").alias("tags"))


@registered("WITH n AS (SELECT conv_id, list(role ORDER BY turn) AS r FROM conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN len(r) = 1 THEN r[1] ELSE concat(array_to_string(list_slice(r, 1, len(r) - 1), ', '), ' and ', r[len(r)]) END AS names FROM n")
def english_lists(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda r: r["role"]).alias("r"))
    return c.select("conv_id", T.english_list(F.col("r")).alias("names"))


FLAGSHIP = bm25_topk
