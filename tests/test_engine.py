"""Goldens and differential tests of the engine."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from probecraft.functions import text as T
from probecraft.operators import chunking, retrieval as R
from probecraft.plans import ask as A, catalog, experiment as X, report
from probecraft.sources import corpus, recording
from probecraft.streaming import events as E

COUNTS = [
    ("Ships left. Crews slept. Gulls stayed.", 3),
    ("Sales rose 4.2% by May. They fell again in June.", 2),
    ("Prof. Okoro chaired it. Minutes followed.", 2),
    ("Some birds (e.g. Gulls) stay. Others go.", 2),
    ("A. B. Crane drew it. Few saw it.", 2),
    ("Was it late? No! Good.", 3),
    ('They wrote "it sank." Then came rain.', 2),
    ("Ask at www.harbour.test for times. They change.", 2),
    ("Approx. 12 boats came in. One was lost.", 2),
    ("Ends without a stop", 1),
    ("Runs on...... Then ends.", 2),
    ("""Left."')')]")]) Then he went.""", 2),
    ("One ends. and goes on. Two.", 2),
    ("", 0),
    ("   \n  ", 0),
    (None, 0),
]


def test_sentences(spark):
    rows = spark.createDataFrame([(t, n) for t, n in COUNTS], "text string, n int")
    for r in rows.select("text", "n", T.sentence_spans(F.col("text")).alias("s")).collect():
        assert len(r["s"]) == r["n"], r["text"]
        assert all(r["text"][s["start"] : s["end"]] == s["text"] for s in r["s"])


def test_claims(spark):
    cases = {
        "The harbour froze for nine days.": True,
        "Here are the dates:": False,
        "I can look further.": False,
        "The passages never mention the year.": False,
        "Let me know when you sail.": False,
        "***": False,
        "Two words": False,
        "Based on the given sources, seven boats were lost.": True,
        "According to the excerpts, perhaps.": False,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "s string").select("s", T.carries_a_claim(F.col("s")).alias("c")).collect()
    assert {r["s"]: r["c"] for r in rows} == cases


def packed(spans, target, overlap, most):
    """The packing rule as a plain loop over (text, start, end)."""
    count = lambda s: len(s[0].split())
    cover = lambda g: (" ".join(s[0] for s in g), g[0][1], g[-1][2])
    out, group = [], []
    for s in spans:
        if not group and count(s) > most:
            words = list(re.finditer(r"\S+", s[0]))
            for i in range(0, len(words), most):
                a, b = words[i].start(), words[min(i + most, len(words)) - 1].end()
                out.append((s[0][a:b], s[1] + a, s[1] + b))
            continue
        group.append(s)
        if sum(map(count, group)) >= target:
            out.append(cover(group))
            keep = min(overlap, len(group) - 1)
            group = group[len(group) - keep :] if keep else []
    if group and (not out or cover(group) != out[-1]):
        out.append(cover(group))
    return out


@pytest.mark.parametrize("policy", [(10, 1, 14), (6, 0, 6), (3, 2, 9), (18, 1, 40)])
def test_chunks(spark, policy):
    rng = random.Random(str(policy))
    texts = []
    for _ in range(60):
        texts.append(" ".join(" ".join(rng.choices(["Aa", "bb", "cc  dd", "é"], k=rng.randint(1, 20))).capitalize() + "." for _ in range(rng.randint(0, 9))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r["doc_id"]: [tuple(s) for s in r["s"]] for r in docs.select("doc_id", T.sentence_spans(F.col("text")).alias("s")).collect()}
    found = {}
    for r in chunking.chunk_documents(docs, chunking.ChunkingPolicy(*policy)).orderBy("doc_id", "ordinal").collect():
        assert r["chunk_id"] == f"{r['doc_id']}#{r['ordinal']}"
        found.setdefault(r["doc_id"], []).append((r["text"], r["start"], r["end"]))
    for i in spans:
        assert found.get(i, []) == packed(spans[i], *policy), i


def test_policies_reject():
    for bad in (lambda: chunking.ChunkingPolicy(0), lambda: chunking.ChunkingPolicy(10, 0, 5), lambda: R.RetrievalPolicy(top_k=0), lambda: R.RetrievalPolicy(diversity=2), lambda: X.AblationPolicy(support_threshold=0), lambda: X.AblationPolicy(max_runs=1)):
        with pytest.raises(ValueError):
            bad()


def test_mmr_prefers_variety():
    same = np.array([1.0, 0.0])
    pool = [(0.9, same, False), (0.89, same, False), (0.5, np.array([0.0, 1.0]), False)]
    assert R.mmr(pool, 2, 0.0) == [0, 1] and R.mmr(pool, 2, 0.6) == [0, 2]
    assert R.mmr([(0.9, same, False), (0.89, same, True), (0.5, np.array([0.0, 1.0]), False)], 2, 0.6) == [0, 1]


def test_verdicts_of_one_claim(spark):
    """One chunk matters, one not at all, one just under the share of the strongest."""
    runs = [("closed", None, 0.10), ("control", None, 0.95), ("loo", "A#0", 0.20), ("loo", "B#0", 0.97), ("loo", "C#0", 0.51)]
    rows = [("q", 0, True, k, c, i, s) for i, (k, c, s) in enumerate(runs)] + [("q", 1, True, k, c, i, 0.8 if k == "closed" else 0.97) for i, (k, c, s) in enumerate(runs)] + [("q", 2, False, "closed", None, 0, 1.0)]
    scores = spark.createDataFrame(rows, "qid string, claim_idx int, checkable boolean, kind string, chunk_id string, position int, survival double")
    out = {r["claim_idx"]: r for r in X.first_pass(scores, X.AblationPolicy()).collect()}
    assert out[0]["verdict"] == "grounded" and [s["chunk_id"] for s in out[0]["support"] if s["credited"]] == ["A#0"]
    assert abs(out[0]["noise"] - 0.05) < 1e-9 and abs(out[0]["support"][0]["effect"] - 0.75) < 1e-9
    assert out[1]["verdict"] == "model_memory" and out[2]["verdict"] == "no_claim" and out[2]["support"] == []


def test_scripted_ablation_end_to_end(spark):
    """A sentence that one excerpt causes is grounded in it; one that is said anyway is memory."""
    chunks = [("q", 0, "budget#0", "It cost 2.1 million dollars."), ("q", 1, "memo#0", "The rollout slipped."), ("q", 2, "log#0", "Nothing else happened.")]
    got = spark.createDataFrame(chunks, "qid string, position int, chunk_id string, text string")
    rules = spark.createDataFrame([(0, "2.1 million", "The project cost 2.1 million dollars."), (1, "", "Water boils at one hundred degrees.")], "rule_ord int, trigger string, sentence string")
    policy = X.AblationPolicy()
    plan = X.base_plan(got, policy)
    full = plan.select("qid").distinct().select("qid", F.lit(-1).alias("run_seq"), F.lit("full").alias("run_id"), F.lit("full").alias("kind"), F.array().cast("array<string>").alias("removed"), F.lit(False).alias("truncated"))
    asked = X.requests(X.visible(plan.unionByName(full), got), spark.createDataFrame([("q", "What did it cost?")], "qid string, question string"))
    answers = X.replay(asked, X.scripted(asked, rules)).withColumn("s", F.explode(T.sentences(F.col("answer"))))
    claims = answers.filter("kind = 'full'").select("qid", "s").withColumn("claim_idx", F.when(F.col("s").contains("cost"), 0).otherwise(1))
    pairs = claims.join(answers.select("qid", "run_id", F.col("s").alias("t")), "qid").select("qid", "claim_idx", "run_id", (F.col("s") == F.col("t")).cast("double").alias("similarity"))
    alive = X.survival(pairs, claims, plan).join(plan, ["qid", "run_id"])
    scores = alive.select("qid", "claim_idx", F.lit(True).alias("checkable"), "kind", F.get("removed", F.lit(0)).alias("chunk_id"), F.col("run_seq").alias("position"), "survival")
    out = {r["claim_idx"]: r for r in X.first_pass(scores, policy).collect()}
    assert out[0]["verdict"] == "grounded" and [s["chunk_id"] for s in out[0]["support"] if s["credited"]] == ["budget#0"]
    assert out[1]["verdict"] == "model_memory"
    with pytest.raises(LookupError):
        X.replay(asked, X.scripted(asked, rules).filter("false"))


def test_sources(spark, tmp_path):
    folder = tmp_path / "docs"
    (folder / "first").mkdir(parents=True)
    (folder / "first" / "note.md").write_text("# Title here\n\nBody.")
    (folder / "b.txt").write_text("\n\nplain")
    (folder / "c.bin").write_text("x")
    rows = {r["doc_id"]: r for r in corpus.validate_documents(corpus.load_documents(spark, str(folder))).collect()}
    assert set(rows) == {"first/note", "b"} and rows["first/note"]["title"] == "Title here"
    lines = tmp_path / "x.jsonl"
    lines.write_text('{"id": "a", "text": "one", "title": "T"}\n\n{"text": "two"}\n')
    rows = {r["doc_id"]: r for r in corpus.load_documents(spark, str(lines)).collect()}
    assert set(rows) == {"a", "3"} and rows["3"]["title"] == "document 3" and rows["a"]["meta"]["line"] == "1"
    lines.write_text('{"id": "a", "text": "one"}\nnot json\n')
    with pytest.raises(corpus.CorpusError, match="line 2"):
        corpus.load_documents(spark, str(lines))
    lines.write_text('{"id": "a", "text": "one"}\n{"id": "a", "text": "two"}\n')
    with pytest.raises(corpus.CorpusError, match="line 1.*line 2"):
        corpus.validate_documents(corpus.load_documents(spark, str(lines)))
    with pytest.raises(FileNotFoundError):
        corpus.load_documents(spark, str(tmp_path / "none"))
    (tmp_path / "questions.txt").write_text("# no\n\n  One?  \n")
    assert [r[0] for r in corpus.sidecar_lines(spark, str(tmp_path / "questions.txt")).collect()] == ["One?"]
    (tmp_path / "probes.json").write_text(json.dumps({"probes": [{"question": "q", "document": "d", "phrase": "p"}]}))
    assert corpus.sidecar_json(spark, str(tmp_path / "probes.json"), "probes", "question string, document string, phrase string").first()["document"] == "d"


def test_vector_cache(spark, tmp_path):
    texts = spark.createDataFrame([("alpha beta",), ("alpha beta",), ("gamma",)], "text string")
    vectors = R.blake_vectors(texts, 64)
    assert all(abs(np.linalg.norm(r["vec"]) - 1) < 1e-5 for r in vectors.collect())
    corpus.write_vectors(vectors.select(T.vector_key(F.col("text")).alias("text_key"), "vec"), str(tmp_path / "v"), "ngram", 64)
    assert corpus.read_vectors(spark, str(tmp_path / "v"), "ngram", 64).count() == 2
    assert corpus.read_vectors(spark, str(tmp_path / "v"), "ngram", 32).count() == 0
    assert R.embed_missing(spark.createDataFrame([("delta",), ("gamma",)], "text string"), vectors, lambda t: R.blake_vectors(t, 64)).count() == 3


def test_stream_fold_equals_batch(spark, tmp_path):
    rows = [(i, i % 3, "run" if i % 2 else "done", float(i)) for i in range(40)]
    events = spark.createDataFrame(rows, "event_id long, user_id int, event_type string, value double")
    events.repartition(4).write.parquet(str(tmp_path / "e"))
    stream = E.latest(E.read_stream(spark, str(tmp_path / "e"), events.schema), "user_id", "event_type")
    query = stream.writeStream.format("memory").queryName("folded").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("folded").collect())) == sorted(map(tuple, E.latest(events, "user_id", "event_type").collect()))


def test_probes_are_whole_phrases(spark, tmp_path):
    """A document that has only the opening of a phrase does not hold it."""
    opening = " ".join(f"word{i}" for i in range(20))
    items = [(1, f"{opening} ends here"), (2, f"{opening} ends there"), (3, f"{opening} ends nowhere")]
    docs = [(1, f"so {opening}  ENDS\nhere ."), (2, f"{opening} ends there"), (3, f"{opening} ends there too"), (4, opening), (5, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(tuple, catalog.probe_uniqueness(spark, str(tmp_path)).collect())) == [(1, 1, True), (2, 2, False), (3, 0, False)]


COST, SLIP, ALWAYS = "The harbour wall cost 3 million crowns.", "The opening moved to the ninth week.", "Salt water freezes below zero degrees."
HELD = [("budget#1#0", "budget#1", "The wall cost 3 million crowns in all. Nothing was left over."), ("plan#0", "plan", "The opening moved to week nine."), ("memo#0", "memo", "All know that the opening moved to week nine.")]


def harbour(spark, rules, questions=("What did it cost?",), chunks=HELD, policy=None, model="claude-haiku-4-5"):
    q = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(questions)], "qid string, question string")
    rows = [(f"q{i}", n, *c) for i in range(len(questions)) for n, c in enumerate(chunks)]
    got = spark.createDataFrame(rows, "qid string, position int, chunk_id string, doc_id string, text string")
    said = spark.createDataFrame([(i, *r) for i, r in enumerate(rules)], "rule_ord int, trigger string, sentence string")
    generate = lambda asked: X.scripted(asked, said, "")
    return A.ask(q, got, generate, [R.embedder("ngram-md5", 256)], policy, model), generate


def by_text(a):
    return {r["text"]: r for r in a.claims.collect()}


def test_ask(spark):
    """A sentence of one source, one of two redundant sources, one that is said regardless."""
    a, generate = harbour(spark, [("3 million", COST), ("week nine", SLIP), ("", ALWAYS)], policy=X.AblationPolicy(coalition_size=2))
    found = by_text(a)
    assert [found[t]["verdict"] for t in (COST, SLIP, ALWAYS)] == ["grounded", "grounded", "model_memory"]
    credited = lambda t: sorted(s["chunk_id"] for s in found[t]["support"] if s["credited"])
    assert credited(COST) == ["budget#1#0"] and credited(SLIP) == ["memo#0", "plan#0"]
    assert all(s["joint"] for s in found[SLIP]["support"] if s["credited"]) and len(found[SLIP]["support"]) == 3
    runs = [r["run_id"] for r in a.runs.orderBy("run_seq").collect()]
    assert runs[:6] == ["full", "closed", "control-0", "loo-budget#1#0", "loo-plan#0", "loo-memo#0"] and runs[6:8] == ["coalition-0", "coalition-1"]
    assert "memo#0 and plan#0" in found[SLIP]["note"] or "plan#0 and memo#0" in found[SLIP]["note"]
    s = report.summaries(a).first()
    assert (s["grounded"], s["checkable"], s["corpus_contributed"], s["truncated"]) == (2, 3, True, False) and s["cost_usd"] > 0
    r = json.loads(report.reports(a, {"survival": "ngram"}).first()["report"])
    assert r["summary"]["runs"] == len(r["runs"]) == len(runs) and len(r["retrieved"]) == 3 and r["claims"][0]["noise_floor"] == 0
    assert f"+ {COST}" in report.lines(json.dumps(r)) and f"~ {ALWAYS}" in report.lines(json.dumps(r))

    places = spark.createDataFrame(HELD, "chunk_id string, doc_id string, text string")
    probes = spark.createDataFrame([("q0", "budget#1")], "qid string, expected_doc string")
    assert X.attribution(a.claims, probes, places).first()["passed"]
    # Asked again without the credited documents, both sentences go.
    again = A.without_credited(a, places, lambda q, removed: places.crossJoin(q).join(removed, ["qid", "doc_id"], "left_anti").withColumn("position", F.lit(0)), generate, [R.embedder("ngram-md5", 256)])
    out = {r["text"]: r for r in again.collect()}
    assert set(out) == {COST, SLIP} and all(r["passed"] for r in out.values()) and out[SLIP]["removed_docs"] == ["memo", "plan"]
    assert report.suite("counterfactual", again) == {"suite": "counterfactual", "trials": 2, "passed": 2, "skipped": 0, "rate": 1.0}
    labels = spark.createDataFrame([("q0", COST, True), ("q0", "Nobody came to the opening at all.", False), ("none", COST, True)], "qid string, sentence string, expected boolean")
    judged = A.injection(a, labels, [R.embedder("ngram-md5", 256)])
    assert sorted((r["sentence"][:6], r["skipped"], r["passed"]) for r in judged.filter("not skipped").collect()) == [("Nobody", False, True), ("The ha", False, True)]
    assert report.suite("injection", judged)["skipped"] == 1
    kept = []
    line = report.dispatch("injection", {"injection": lambda: judged}, kept.append)
    assert line.startswith("precision 100%") and json.loads(kept[0])["tp"] == 1
    with pytest.raises(ValueError):
        report.dispatch("other", {})


def test_ask_within_a_budget(spark):
    a, _ = harbour(spark, [("3 million", COST), ("week nine", SLIP)], policy=X.AblationPolicy(max_runs=3))
    assert a.questions.first()["truncated"] and a.runs.count() == 3 and "closed" in {r["run_id"] for r in a.runs.collect()}
    assert "undetermined" in {r["verdict"] for r in a.claims.collect()}
    a, _ = harbour(spark, [("week nine", SLIP)], policy=X.AblationPolicy(max_runs=7))
    assert a.runs.count() == 7 and a.questions.first()["truncated"]


def test_ask_without_hits_or_claims(spark):
    """A question that retrieved nothing runs closed-book; one whose answer is empty ends at once."""
    a, _ = harbour(spark, [("", ALWAYS)], chunks=[])
    assert a.questions.first()["empty"] and [r["run_id"] for r in a.runs.orderBy("run_seq").collect()] == ["full", "closed"]
    assert by_text(a)[ALWAYS]["verdict"] == "model_memory"
    events = [r["type"] for r in E.log(a, report.reports(a)).orderBy("seq").collect()]
    assert events == ["question", "retrieved", "empty", "answer", "run", "verdicts", "done", "report", "complete"]
    a, _ = harbour(spark, [("nowhere", COST)])
    assert a.claims.count() == 0 and a.runs.count() == 1 and not a.questions.first()["truncated"]
    assert [r["type"] for r in E.log(a, report.reports(a)).orderBy("seq").collect()] == ["question", "retrieved", "answer", "done", "report", "complete"]
    assert report.summaries(a).first()["checkable"] == 0
    with pytest.raises(ValueError):
        harbour(spark, [], questions=("  ",))


def test_search_without_documents_is_search_of_the_rest(spark):
    rng = random.Random(5)
    pool = "tide wharf crane rope salt storm lamp gull net anchor".split()
    rows = [(f"d{i}#{k}", f"d{i}", k, " ".join(rng.choices(pool, k=12))) for i in range(14) for k in range(3)]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id string, ordinal int, text string")
    q = spark.createDataFrame([("a", "storm at the wharf"), ("b", "lamp rope"), ("c", "zzz")], "qid string, question string")
    embed = R.embedder("ngram-md5", 128)
    less = spark.createDataFrame([(i, d) for i in "abc" for d in ("d1", "d4", "d5")], "qid string, doc_id string")
    key = lambda df: sorted((r["qid"], r["position"], r["chunk_id"], round(r["score"], 9)) for r in df.collect())
    one = key(R.search(chunks, q, embed, removed=less))
    assert one == key(R.search(chunks.filter("doc_id not in ('d1', 'd4', 'd5')"), q, embed))
    assert one != key(R.search(chunks, q, embed)) and {x[0] for x in one} >= {"a", "b"}


def test_nearest_in_passes(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 8))
    x[50:60] = x[40]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, vec array<double>").repartition(5)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:45])], "qid long, vec array<double>")
    monkeypatch.setattr(R, "QUESTION_BYTES", 8 * 8 * 20)
    near, moments = R.nearest(vectors, asked, 7)
    found = {}
    for r in R.ranked(near, "cosine", 7).orderBy("qid", "rank").collect():
        found.setdefault(r["qid"], []).append(r["chunk_id"])
    for i in range(45):
        assert found[i] == np.lexsort((np.arange(300), -np.round(x @ x[i], 9)))[:7].tolist()
    assert {r["n"] for r in moments.collect()} == {300}


@pytest.mark.parametrize("lines", [2, 2048])
def test_survival_matrix_is_its_sql_without_a_row_for_each_gram(spark, tmp_path, monkeypatch, lines):
    duckdb = pytest.importorskip("duckdb")
    rows = [(1, 0, "What was it?"), (1, 1, "The Cat sat.\n\nOn a mat ÄÖ İstanbul\nthe end\nq"), (1, 2, "the cat sat on a mat"), (1, 2, "the cat\nsat on\nthe end"), (1, 3, None), (1, 4, "")]
    rows += [(2, 1, "dup one\nline two"), (2, 1, "dup two"), (2, 1, "dup one\nline two\nline three more"), (2, 0, "line one\nline two dup"), (2, 5, "dup"), (3, 1, "alone"), (4, 0, "no claims"), (4, 2, "x")]
    rows += [(None, 1, "no name"), (None, 2, "no name"), (5, 1, None), (5, 2, "x y z"), (6, None, "no turn"), (6, 1, "no turn here"), (6, 2, "no TURN\r\nthere\ttoo 123-456"), (7, 1, "same same"), (7, 2, "same same"), (7, 3, "a\n\n\n\nb\nsame")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").withColumn("role", F.lit("user")).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(X, "LINES", lines)
    found = catalog.survival_matrix(spark, str(tmp_path))
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(map(tuple, found.collect())) == sorted(db.execute(catalog.ORACLES["survival_matrix"]).fetchall())


def test_gram_hasher_counts_as_rows_do(spark):
    rng = random.Random(4)
    texts = ["", "   ", " a ", " 0 z ", *("".join(rng.choice("ab 09z") for _ in range(rng.randrange(40))) for _ in range(60))]
    want = np.zeros((len(texts), 64))
    padded = spark.createDataFrame(list(enumerate(texts)), "k int, text string").withColumn("p", T.gram_text(F.col("text")))
    for r in R.hashed_grams(padded, "k", 64).collect():
        want[r["k"], r["bucket"]] = r["w"]
    hasher = R.GramHasher(64)
    hasher.CHARS = 50
    assert np.allclose(hasher.vectors([[r["p"]] for r in padded.orderBy("k").collect()]), want, atol=1e-12)


def test_embedders_and_generators(spark, tmp_path):
    texts = spark.createDataFrame([("a b",), ("c",), ("a b",)], "text string")
    with pytest.raises(ValueError):
        R.embedder("none")
    own = R.embedder("ngram", 32)
    assert own.identity == "ngram-32"
    cache = own(texts.filter("text = 'c'"))
    assert R.cached(cache, own)(texts).count() == 2 and R.cache_use(texts, cache).first() == (1, 1)
    with pytest.raises(LookupError):
        R.frozen(cache)(texts)
    with pytest.raises(LookupError):
        R.vectors_for(cache.withColumnRenamed("text", "chunk_id"), spark.createDataFrame([("x",)], "chunk_id string"))
    assert R.batched(lambda ts: [[3.0, 4.0]] * len(ts), 1)(texts).first()["vec"] == [0.6, 0.8]
    tries = []

    def shaky():
        tries.append(1)
        if len(tries) < 3:
            raise ConnectionError
        return "fine"

    assert R.retried(shaky, most=0.01) == "fine" and len(tries) == 3
    with pytest.raises(KeyError):
        R.retried(lambda: {}[1])
    asked = spark.createDataFrame([("k1", "s", "p"), ("k2", "s", "q"), ("k1", "s", "p")], "request_key string, system string, prompt string")
    live = X.batched(lambda s, p, m, n: (f"{p}!", 1, 2))
    assert sorted(r["answer"] for r in live(asked).collect()) == ["p!", "q!"]
    path = str(tmp_path / "deep" / "answers")
    assert recording.load_answers(spark, path).count() == 0
    with pytest.raises(LookupError):
        recording.replaying(recording.load_answers(spark, path))(asked)
    recording.save_answers(live(asked.limit(1)), path)
    both = recording.recording(recording.load_answers(spark, path), live)(asked)
    assert sorted((r["request_key"], r["cached"]) for r in both.collect()) == [("k1", True), ("k2", False)]
    with pytest.raises(ValueError):
        recording.save_answers(both, "")


def test_demo_round_trip(spark, tmp_path):
    folder = str(tmp_path / "demo")
    docs = spark.createDataFrame([("a", "A", "Storms came. They went."), ("b", "B", "Ünder the lamp.")], "doc_id string, title string, text string")
    with pytest.raises(FileNotFoundError):
        recording.load_demo(spark, folder)
    corpus.write_corpus(docs.coalesce(1), f"{folder}/corpus.jsonl")
    corpus.write_vectors(R.gram_vectors(docs, 16).select(T.vector_key(F.col("text")).alias("text_key"), "vec"), f"{folder}/vectors", "ngram-md5", 16)
    recording.save_answers(spark.createDataFrame([("k", "x", 1, 2)], "request_key string, answer string, input_tokens long, output_tokens long"), f"{folder}/answers")
    recording.write_manifest(spark, folder, ["Who?"], "ngram-md5", 16, title="t", retrieval={"top_k": 2}, counterfactual={"rate": 1})
    text = next(p for p in (tmp_path / "demo" / "corpus.jsonl").iterdir() if p.suffix == ".txt").read_text()
    (tmp_path / "one.jsonl").write_text(text)
    assert "Ünder" in text
    import shutil

    shutil.rmtree(f"{folder}/corpus.jsonl")
    shutil.copy(tmp_path / "one.jsonl", f"{folder}/corpus.jsonl")
    demo = recording.load_demo(spark, folder)
    assert demo.questions == ("Who?",) and demo.retrieval.top_k == 2 and demo.more == {"counterfactual": {"rate": 1}}
    assert demo.embed(docs.select("text")).count() == 2 and corpus.fetch(demo.documents, "b")["title"] == "B"
    with pytest.raises(LookupError):
        demo.embed(spark.createDataFrame([("new",)], "text string"))
    with pytest.raises(LookupError):
        corpus.fetch(demo.documents, "c")


def test_lines_are_numbered_across_splits(spark, tmp_path):
    path = tmp_path / "many.jsonl"
    path.write_text("".join(json.dumps({"text": f"t{i}", "title": "" if i % 2 else "T"}) + "\n" + "\n" * (i % 3 == 0) for i in range(400)))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = corpus.load_documents(spark, str(path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    lines = path.read_text().split("\n")
    assert len(rows) == 400 and all(json.loads(lines[r["doc_ord"] - 1])["text"] == r["text"] for r in rows)
    assert all(r["title"] == ("T" if int(r["text"][1:]) % 2 == 0 else f"document {r['doc_ord']}") for r in rows)
    assert corpus.sidecar_json(spark, corpus.beside(spark, str(path), "labels.json"), "labels", "question string, grounded boolean").count() == 0
    with pytest.raises(FileNotFoundError):
        corpus.sidecar_lines(spark, corpus.beside(spark, str(path), "questions.txt"))
    bad = spark.createDataFrame([("x ", "t", "a"), ("", "u", "b"), ("y", "v", "c"), ("y", "w", "d")], "doc_id string, title string, text string").withColumn("meta", F.create_map().cast("map<string,string>"))
    with pytest.raises(corpus.CorpusError, match="titled t.*titled u.*duplicate id y"):
        corpus.validate_documents(bad)


def test_event_sinks(spark, tmp_path):
    a, _ = harbour(spark, [("3 million", COST)])
    log = E.log(a, report.reports(a))
    heard = E.Collector()
    E.emit(heard, log)
    E.emit(None, log)

    async def later(batch, number):
        heard(batch, number)

    E.emit(later, log)
    once = len(heard.events) // 2
    assert heard.types()[:once] == heard.types()[once:] and heard.types()[0] == "question" and len(heard.of("report")) == 2
    runs = a.runs.agg(F.sum("input_tokens")).first()[0]
    assert E.run_meters(log).first()["input_tokens"] == runs
    assert E.run_meters(log.filter("type <> 'done'")).first()["runs"] == a.runs.count() - 1
    log.write.parquet(str(tmp_path / "log"))
    query = E.sse_sink(E.read_stream(spark, str(tmp_path / "log"), log.schema, 100), str(tmp_path / "sse"), str(tmp_path / "c"))
    query.processAllAvailable()
    query.stop()
    got = "".join(p.read_text() for p in sorted((tmp_path / "sse").rglob("*.txt")))
    assert got.count("event: ") == once and got.startswith("event: question\ndata: {") and got.endswith("event: complete\ndata: {}\n\n")
    assert E.failed("q", "gone", spark).count() == 2


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 40
    assert e.entry(spark).columns == ["qid", "chunk_id", "score", "rank"]
