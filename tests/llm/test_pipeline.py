"""The corpus pipeline, stage by stage, against brute force on what each stage was given."""

import hashlib
import os
import random

import pytest

import corpus_pipeline
from probecraft.llm import op4_jaccard_join, op6_bpe, op9_quality_rules, op10_mixing
from probecraft.llm.common import Scratch, shared_dir

from test_operators import jaccard_truth, sentence, suffix_truth

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean documents of two languages, copies, near copies, shared passages, texts without letters, nulls, repeated rows."""
    rng, rows = random.Random(21), []
    passage = {lang: sentence(rng, lang, 60) for lang in ("en", "de")}
    for i in range(120):
        lang = rng.choice(["en", "de"])
        text = sentence(rng, lang, rng.randint(60, 120))
        if i % 9 == 4:
            text = f"{sentence(rng, lang, 80)}\n{passage[lang]}\n{sentence(rng, lang, 70)}"
        rows.append((i, text, lang, f"s{i % 4}", len(text)))
    for i in range(120, 150):
        words = rows[rng.randrange(9)][1].split(" ")
        if i % 2:
            words[rng.randrange(len(words))] = "thing"
        rows.append((i, " ".join(words), "en", "s1", 0))
    rows += [(150, None, None, None, None), (151, "", None, None, 0), (152, "12 34 !!", None, "s2", 8), rows[3]]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(path / "documents.parquet"))
    labels = [(i, int(i % 5 > 0), int(i % 7 == 0)) for i in range(0, 120, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def test_stages(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "suffix_dedup", "mixing", "bpe"]
    given = spark.read.parquet(f"{folder}/documents.parquet")
    docs, seen = given, {}
    for name, stage in corpus_pipeline.STAGES:
        rows = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, folder)
        got = out.collect()
        if name != "bpe":
            assert out.columns == given.columns
        kept = {r["doc_id"] for r in got}
        if name == "language_id":
            assert kept >= set(range(120)) and kept.isdisjoint({150, 151, 152})
        elif name == "jaccard_join":
            truth = jaccard_truth(rows)
            assert kept == {i for i, (_, c) in truth.items() if i == c} and len(kept) < len(truth)
        elif name == "suffix_dedup":
            truth = suffix_truth(rows)
            assert kept == {i for i, v in truth.items() if v[0] > v[1]} and any(v[1] for v in truth.values())
            assert all(hashlib.sha256(r["text"].encode()).hexdigest() == truth[r["doc_id"]][3] for r in got)
        elif name == "mixing":
            rate = {r["doc_id"]: r["rate"] for r in op10_mixing.mix(spark, docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
            count = {i: [r["doc_id"] for r in got].count(i) for i in rate}
            assert all(int(rate[i]) <= n <= int(rate[i]) + 1 for i, n in count.items())
            assert {tuple(r) for r in got} <= set(rows)
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(op6_bpe.vocabulary_path())
            texts = {r[0]: r[1] for r in rows}
            assert len(got) == len(rows)
            for r in got:
                ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
                assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        seen[name] = len(got)
        path = f"{folder}/after_{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    assert seen["language_id"] > seen["jaccard_join"] >= seen["suffix_dedup"] > 0 and seen["mixing"] == seen["bpe"]
    assert corpus_pipeline.run(spark, folder).count() == seen["bpe"]


def test_jaccard_stage_leaves_only_what_its_result_reads(spark, folder):
    """Tables that the stage leaves in the shared folder count as disk of all later stages."""
    top = f"{shared_dir(spark).removeprefix('file://')}/probecraft"
    os.makedirs(top, exist_ok=True)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    truth = {i: c for i, (_, c) in jaccard_truth([tuple(r) for r in docs.collect()]).items()}
    for given in (docs, docs.distinct()):
        before = set(os.listdir(top))
        out = op4_jaccard_join.stage(spark, given, folder)
        left = set(os.listdir(top)) - before
        assert left and left <= {f.split("/")[-2] for f in out.inputFiles()}
        assert not any("binary" in dict(spark.read.parquet(f"{top}/{x}").dtypes).values() for x in left)
        assert {r["doc_id"] for r in out.collect()} == {i for i, c in truth.items() if i == c}


def test_scratch_keeps_what_plans_read(spark):
    scratch = Scratch(spark)
    a, b, c = (scratch.write(spark.range(n)) for n in (3, 4, 0))
    scratch.keep(a.join(c, "id", "left_anti"))
    assert a.join(c, "id", "left_anti").count() == 3
    assert {id(x) for x in (a, c)} == set(scratch.paths) and id(b) not in scratch.paths


def test_host_verdict_drops_documents(spark, tmp_path):
    """A host whose documents mostly fail loses those that pass as well; one with few failures loses none of them."""
    rng, rows = random.Random(2), []
    for i in range(400):
        good = i % 40 == 0 if i < 300 else i % 40 != 0
        rows.append((i, sentence(rng, "en", 40) if good else "too few words", "en", "bad" if i < 300 else "fine", 0))
    path = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    found = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in op9_quality_rules.query(spark, path).collect()}
    assert all(found[i] == (False, False) for i in range(0, 300, 40))
    assert all(found[i] == ((True, False) if i % 40 == 0 else (False, True)) for i in range(300, 400))
