"""The training-data operators against brute force, round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from probecraft.llm import op1_licenses, op2_chat, op3_language_id, op4_jaccard_join, op5_ann, op6_bpe, op7_token_files, op8_suffix_dedup, op9_quality_rules, op10_mixing
from probecraft.llm.common import Scratch, components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
STEMS = {"en": ["the", "of", "thing", "ation", "with", "ough", "ing", "er"], "de": ["der", "und", "sch", "keit", "ung", "ein", "pf", "zu"]}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choices(STEMS[lang], k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, a shared passage, repeats, one very long text, nulls, empty texts, a repeated row."""
    rng = random.Random(3)
    passage = sentence(rng, "en", 40)
    out = []
    for i in range(60):
        lang = rng.choice(["en", "de"])
        text = sentence(rng, lang, rng.randint(1, 90))
        if i % 7 == 3:
            text = f"{text}\n{passage}\n{sentence(rng, lang, 10)}"
        out.append([i, text, lang, "hot" if i % 3 else f"s{i % 5}", len(text), "x"])
    for i in range(60, 90):
        base = out[rng.randrange(3)][1].split(" ")
        if i % 2:
            base[rng.randrange(len(base))] = "changed"
        out.append([i, " ".join(base), "en", "hot", 0, None])
    out += [[90, None, None, None, None, None], [91, "", "en", "s1", 0, "y"], [92, "   \n\t", None, "s1", 5, "y"], [93, "12 34 !!", "en", "s2", 8, "y"]]
    out += [[94, "ab ab ab ab ab ab ab ab ab ab ab ab ab\nline one\nline one\n é É ß", "de", "s2", 0, "z"], [95, sentence(rng, "de", 6000), "de", "s3", 0, "z"]]
    out += [[96, "x" * 300, "en", "s3", 0, "z"], [97, "y" + "x" * 120, "en", "s3", 0, "z"], [98, "<|endoftext|> a  b \n c", "en", None, 0, "z"], [98, "<|endoftext|> a  b \n c", "en", None, 0, "z"]]
    return [tuple(r) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df, *key):
    return {tuple(r[k] for k in key): r.asDict() for r in df.collect()}


def test_components(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r["id"]: r["label"] for r in components(Scratch(spark), edges).collect()}
    assert all(found[i] == 0 for i in range(41)) and found[100] == found[101] == 100


def jaccard_truth(rows):
    sets = {}
    for i, text, *_ in rows:
        w = SPACE.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and sets[b]:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("block", [2048, 6])
def test_jaccard_join(spark, docs, rows, monkeypatch, block):
    monkeypatch.setattr(op4_jaccard_join, "BLOCK", block)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op4_jaccard_join.join(spark, docs).collect()}
    assert found == jaccard_truth(rows)


def test_jaccard_chains(spark):
    """Links that only chains of near copies give, within one large and many small blocks."""
    rng = random.Random(9)
    rows = []
    for g in range(12):
        words = [f"w{g}x{k}" for k in range(60)]
        for v in range(rng.randint(2, 14)):
            at = rng.randrange(60)
            words = [*words[:at], f"v{g}y{v}", *words[at + 1 :]]
            rows.append((g * 100 + v, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op4_jaccard_join.join(spark, docs).collect()}
    assert found == jaccard_truth(rows)


@pytest.mark.parametrize("forested", [True, False])
def test_signature_tree_skips_only_impossible_pairs(forested):
    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 1 << 63, 80, dtype=np.uint64)) for _ in range(40)]
    sets = [np.unique(np.concatenate([rng.permutation(base[i % 40])[: rng.integers(60, 80)], rng.integers(0, 1 << 63, rng.integers(0, 12), dtype=np.uint64)])) for i in range(400)]
    sizes = np.array([len(s) for s in sets])
    tree, forest, truth = op4_jaccard_join.SignatureTree(sets, sizes), op4_jaccard_join.Forest(len(sets)), op4_jaccard_join.Forest(len(sets))
    found = op4_jaccard_join.traverse(tree, forest if forested else None)
    pairs = [(j, i) for i in range(len(sets)) for j in range(i) if op4_jaccard_join.linked(len(np.intersect1d(sets[i], sets[j])), sizes[i], sizes[j])]
    if not forested:
        assert sorted((min(p), max(p)) for p in found) == sorted(pairs)
        assert tree.seen["compared"] < len(sets) ** 2 / 20 and tree.seen["by_bitmap"] > tree.seen["nodes"] / 2
        return
    for i, j in pairs:
        truth.join(i, j)
    assert forest.labels().tolist() == truth.labels().tolist()


def test_jaccard_links_and_rows_without_id(spark, rows, monkeypatch):
    """All links between classes, with small and with dealt-out blocks; a row without doc_id names no component."""
    for block in (2048, 4):
        monkeypatch.setattr(op4_jaccard_join, "BLOCK", block)
        pairs, members = op4_jaccard_join.links(spark, spark.createDataFrame(rows, SCHEMA))
        cls = {r["doc_id"]: r["cls"] for r in members.collect()}
        sets = {i: set(zip(*((SPACE.findall((t or "").lower()))[k:] for k in range(5)))) for i, t, *_ in rows}
        truth = {tuple(sorted((cls[a], cls[b]))) for a in sets for b in sets if cls[a] != cls[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
        got_ = [(r["a"], r["b"]) for r in pairs.collect()]
        assert len(got_) == len(set(got_)) and truth <= set(got_)
        few = spark.createDataFrame([(5, "a b c d e f"), (None, "a b c d e f"), (9, "a b c d e f")], "doc_id long, text string")
        found = sorted(map(str, ((r["doc_id"], r["component_id"]) for r in op4_jaccard_join.join(spark, few).collect())))
        assert found == ["(5, 5)", "(9, 5)", "(None, None)"]


def test_jaccard_of_common_shingles(spark, monkeypatch):
    """Shingles that are hot in some deals only, and texts longer than a portion."""
    from probecraft.llm import common

    monkeypatch.setattr(common, "PORTION", 4096)
    rng = random.Random(4)
    line = sentence(rng, "en", 30)
    rows = [(i, f"{line} {sentence(rng, 'de', rng.randint(0, 9))}", "x") for i in range(90)] + [(500, sentence(rng, "de", 3000), "x")]
    rows += [(501, rows[-1][1] + " end", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cls string").repartition(4)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op4_jaccard_join.join(spark, docs).collect()}
    assert found == jaccard_truth(rows)


def test_hashed_words_are_words():
    from probecraft.llm import common

    rng = random.Random(8)
    texts = ["".join(rng.choices("ab é\t\n\x0b\u2003\x1c", k=rng.randint(0, 60))).encode() for _ in range(300)]
    names = {}
    for lo, hi, owner, h in common.word_sequences(texts):
        words = [(i, w) for i in range(hi - lo) for w in re.split(rb"[\x20\x09-\x0D]+", texts[lo + i]) if w]
        assert owner.tolist() == [i for i, _ in words]
        assert all(names.setdefault(w, x) == x for (_, w), x in zip(words, h.tolist(), strict=True))
    assert len(set(names.values())) == len(names) > 100


def suffix_truth(rows, size=50):
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    least = {}
    for i, b in texts:
        for k in range(len(b) - size + 1):
            s = b[k : k + size]
            least[s] = min(i, least.get(s, i))
    out = {}
    for i, b in texts:
        cut = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if least[b[k : k + size]] < i:
                cut[k : k + size] = b"\1" * size
        kept = bytes(x for x, c in zip(b, cut, strict=True) if not c)
        out[i] = (len(b), sum(cut), len(re.findall(b"\1+", bytes(cut))), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark, docs, rows):
    found = {r["doc_id"]: tuple(r)[1:] for r in op8_suffix_dedup.deduplicate(spark, docs, digest=True).collect()}
    assert found == suffix_truth(rows)


def test_suffix_array_order():
    rng = np.random.default_rng(1)
    for k in range(40):
        t = np.append(rng.integers(k % 2, 1 + k % 4 + 1, 200), 0).astype(np.uint16)
        sa = op8_suffix_dedup.suffix_array(t, 50)
        keys = []
        for i in sa.tolist():
            s = t[i : i + 50].tolist()
            keys.append(tuple(s[: s.index(0) + 1] if 0 in s else s))
        assert sorted(sa.tolist()) == list(range(len(t))) and keys == sorted(keys)


def test_suffix_stage_texts(spark, docs, rows):
    kept = {r["doc_id"]: r["text"] for r in op8_suffix_dedup.stage(spark, docs, "").collect()}
    truth = suffix_truth(rows)
    assert all(hashlib.sha256(t.encode()).hexdigest() == truth[i][3] for i, t in kept.items() if t.isascii())
    assert set(kept) == {i for i, v in truth.items() if v[0] > v[1]}


def test_quality_rules(spark, docs, rows):
    found = got(op9_quality_rules.quality(spark, docs), "doc_id")
    for i, text, *_ in rows:
        text = text or ""
        w = SPACE.findall(text)
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        cover = {p for k, g in enumerate(grams) if grams.count(g) > 1 for p in range(k, k + 5)} if len(w) < 1000 else None
        lines, seen = 0, set()
        for line in text.split("\n"):
            if SPACE.search(line):
                lines += line in seen
                seen.add(line)
        r = found[(i,)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), lines)
        if cover is not None:
            assert r["n_repeat_words"] == len(cover) and r["base_failed"] == (len(w) < 10 or 100 * len(cover) > 20 * len(w))
        assert not (r["base_failed"] and r["kept"])


def test_host_verdicts_shrink(spark):
    stats = spark.createDataFrame([("bad", True)] * 90 + [("bad", False)] * 10 + [("good", False)] * 200 + [("tiny", True)], "source string, base_failed boolean")
    found = got(op9_quality_rules.host_verdicts(stats, "source"), "host")
    assert not found[("bad",)]["host_kept"] and found[("good",)]["host_kept"] and found[("tiny",)]["host_rate"] < 1


def test_bpe_is_the_library(spark, docs, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(op6_bpe.vocabulary_path())
    found = got(op6_bpe.encode_documents(spark, docs, ids=False), "doc_id")
    full = got(op6_bpe.encode_documents(spark, docs), "doc_id")
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        r = found[(i,)]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
        assert full[(i,)]["token_ids"] == ids and full[(i,)]["decoded"] == decoded and "source" in full[(i,)]


def test_bpe_odd_letters():
    from tokenizers import Tokenizer

    library, codec = Tokenizer.from_file(op6_bpe.vocabulary_path()), op6_bpe.Codec(op6_bpe.vocabulary_path())
    rng = random.Random(1)
    pool = [chr(c) for c in (*range(0, 0x250), *range(0x370, 0x400), *range(0x2000, 0x2070), 0x130, 0x3A3, 0x212B, 0xFB01, 0x1F600, 0x85, 0x3000, *range(0x300, 0x320))]
    for _ in range(3000):
        text = "".join(rng.choice(pool) if rng.random() < 0.5 else rng.choice("aB 's're12!?") for _ in range(14))
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids
    word = "abcd" * 200
    assert codec.encode(word) == library.encode(word, add_special_tokens=False).ids


def test_bpe_of_every_code_point():
    """Each alone between letters and doubled before a digit; combining marks meet a letter."""
    from tokenizers import Tokenizer

    library, codec = Tokenizer.from_file(op6_bpe.vocabulary_path()), op6_bpe.Codec(op6_bpe.vocabulary_path())
    points = [c for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000] + [*range(0xE0000, 0xE0200), 0x10FFFF]
    texts = ["".join(f"a{chr(c)}a {chr(c)}{chr(c)}1 " for c in points[i : i + 400]) for i in range(0, len(points), 400)]
    flat, start = codec.many(texts)
    for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert flat[start[i] : start[i + 1]].tolist() == e.ids


def test_merge_order_is_id_order(tmp_path):
    import json

    op7_token_files.check_merges(op7_token_files.vocabulary_path())
    (tmp_path / "x.json").write_text(json.dumps({"model": {"vocab": {"a": 0, "b": 1, "ab": 2, "ba": 3}, "merges": ["b a", "a b"]}}))
    with pytest.raises(ValueError):
        op7_token_files.check_merges(str(tmp_path / "x.json"))


def test_clashing_columns(spark):
    """Columns with the operators' own names stay what they are."""
    text = "a passage that occurs in both of the texts, word by word, and is long enough " * 2
    rows = [(1, f"{text}x", 7, "c", "s", True, "g", 3, "r"), (2, f"y{text}", 8, None, "s", False, "g", 4, "r"), (None, f"{text}x", 9, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, th int, copy string, spans string, _set boolean, given string, _copies int, rest string")
    out = op8_suffix_dedup.deduplicate(spark, docs)
    assert out.columns == docs.columns
    got_ = {r["th"]: r for r in out.collect()}
    assert got_[7] == docs.filter("th = 7").first() and got_[9] == docs.filter("th = 9").first()
    assert got_[8]["text"] == "y" and got_[8]["rest"] == "r" and got_[8]["_copies"] == 4
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    mixed = op10_mixing.mix(spark, docs.filter("doc_id is not null"), labels)
    assert mixed.columns == [*docs.columns, "tokens", "domain", "posterior", "rate"]
    assert {r["th"]: r["_set"] for r in mixed.collect()} == {7: True, 8: False}
    again = op10_mixing.resample(mixed.withColumn("rate", F.lit(2.0)))
    assert again.columns == mixed.columns and again.count() == 4


def test_bpe_merger():
    vocabulary, rng = op6_bpe.Vocabulary(op6_bpe.vocabulary_path()), random.Random(2)
    words = ["".join(rng.choices("etaoinshrdlu\u00e9\u4e2d", k=rng.randint(1, 12))) for _ in range(3000)] + ["long" * 100, "x"]
    want = [vocabulary.merge(w) for w in words]
    merger = op6_bpe.Merger(vocabulary)
    assert merger.many(words) == want and merger.many([]) == []
    odd = sorted({merger.ranks[b"th"], merger.ranks[b"e\n"]})
    assert op6_bpe.Merger(vocabulary, odd).many(words) == want  # these are merged one by one


def test_bpe_batches():
    from tokenizers import Tokenizer

    library, codec = Tokenizer.from_file(op6_bpe.vocabulary_path()), op6_bpe.Codec(op6_bpe.vocabulary_path())
    texts = ["a  b\tc\n\nd", None, "", "x <|endoftext|> y", " ", "it's 12 <|startoftext|>", "plain words", "<|endoftext|>", "\x1c\u2028z\u00a0"]
    flat, start = codec.many(texts)
    numerals, decoded = codec.strings(flat, start)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert flat[start[i] : start[i + 1]].tolist() == ids and numerals[i] == " ".join(map(str, ids))
        assert decoded[i] == library.decode(ids, skip_special_tokens=False)


def test_lexicon_round_trip(tmp_path):
    words = sorted({w.encode() for w in ["a", "ab", "abc", "b", "bc", "é", "zz", "running", "gunning", "stunning"]})
    outputs = {w: [len(w), *w] for w in words}
    op6_bpe.build_lexicon(words, outputs, str(tmp_path / "x"))
    lexicon = op6_bpe.Lexicon(str(tmp_path / "x"))
    assert all(lexicon.get(w) == outputs[w] for w in words)
    assert all(lexicon.get(w) is None for w in (b"", b"ac", b"runnin", b"runningg", b"\xff"))
    op6_bpe.build_lexicon([], {}, str(tmp_path / "y"))
    assert op6_bpe.Lexicon(str(tmp_path / "y")).get(b"a") is None


def test_token_files(spark, docs, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(op7_token_files.vocabulary_path())
    found = sorted(map(tuple, op7_token_files.read(op7_token_files.write(spark, docs, Scratch(spark))).collect()))
    at, want = 0, []
    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert found == sorted(want)


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 59, 60, 61, 5000):
        for top in (2, 300, 50257, 1 << 31, (1 << 32) - 1):
            ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
            ids[n // 3 : n // 2] = 0
            assert (op7_token_files.unpack(op7_token_files.pack(ids)) == ids).all()
    ids = rng.integers(0, 50257, 20_000).astype(np.uint32)
    block = op7_token_files.write_block([ids[:7], ids[7:7], ids[7:]])
    offsets, back = op7_token_files.read_block(block)
    assert offsets.tolist() == [0, 7, 7, 20_000] and (back == ids).all()
    first, part = op7_token_files.read_group(block, 2)
    assert (ids[first : first + len(part)] == part).all()


def test_language_id(spark, docs, rows):
    model = op3_language_id.fit(docs.filter(~op3_language_id.held_out()))
    found = op3_language_id.predict(docs, model)
    assert found.columns.count("score") == 1
    answers = got(found.select("doc_id", "lang_pred", "score"), "doc_id")
    long_ = [r for r in rows if r[0] < 60 and len(r[1]) > 100 and r[0] % 7 != 3]
    assert sum(answers[(r[0],)]["lang_pred"] == r[2] for r in long_) >= 0.95 * len(long_)
    assert all(answers[(i,)]["lang_pred"] == "und" for i in (90, 91, 92, 93))
    assert all(0 <= r["score"] <= 1 for r in answers.values())


def test_language_sample_is_no_prefix(spark):
    """Texts that all open with the same long header still teach their languages."""
    rng = random.Random(5)
    data = [(i, "0123456789 " * 100 + sentence(rng, lang, 600), lang) for i, lang in enumerate(["en", "de"] * 8)]
    model = op3_language_id.fit(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    assert all(len(set(re.findall("[a-z]+", d.decode()))) > 100 for d in model.values()) and set(model) == {"de", "en"}


def test_language_ties_are_rejected():
    """A short text that no dictionary favours has no language; one that a dictionary favours keeps it."""
    classify = op3_language_id.Classifier({"de": b"der und schkeit ung ein pf zu " * 20, "en": b"the of thing ation with ough " * 20})
    assert classify("xq")[1:] == (0.0, True)
    assert classify("schkeit ung ein pf zu") == ("de", classify("schkeit ung ein pf zu")[1], False)


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, 24)).astype(np.float32)
    x[300:700] = x[5]
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    data += [(1000, None), (1020, [0.0] * 24), (1040, [float("nan")] * 24), (1060, [None] * 24), (1080, [1.0]), (None, [1.0] * 24), (3, x[3].tolist())]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    found = op5_ann.search(spark, vectors, share=1.0).collect()
    y = x.astype(float)
    hits, total = 0, 0
    for q in range(0, 900, 20):
        score = y @ y[q]
        order = sorted((i for i in range(900) if i != q), key=lambda i: (-round(score[i], 9), i))[:20]
        mine = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert all(abs(r["score"] - score[r["vec_id"]]) < 1e-9 for r in mine)
        hits += len({r["vec_id"] for r in mine} & set(order))
        total += 20
    assert hits >= 0.97 * total and {r["query_id"] for r in found} == set(range(0, 900, 20))


def test_recall_as_registered(spark):
    """The query itself, on clustered and on shapeless vectors, against brute force."""
    rng = np.random.default_rng(12)
    centres = rng.standard_normal((40, 32)) * 3
    for x in (rng.standard_normal((3000, 32)), centres[rng.integers(0, 40, 3000)] + rng.standard_normal((3000, 32))):
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
        found = {}
        for r in op5_ann.search(spark, rows).collect():
            found.setdefault(r["query_id"], set()).add(r["vec_id"])
            assert abs(r["score"] - x[r["query_id"]] @ x[r["vec_id"]]) < 1e-9
        assert len(found) == 150
        hit = 0
        for q, near in found.items():
            score = x @ x[q]
            score[q] = -np.inf
            hit += len(near & set(np.argsort(-score)[:20].tolist()))
        assert hit / (20 * len(found)) >= 0.9


def test_nearest_neighbours_of_few(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r["vec_id"], r["score"]) for r in op5_ann.search(spark, few).orderBy("rank").collect()] == [(1, 2, 1.0), (2, 1, 0.0)]


def test_licenses(spark, docs):
    lines = [("Licensed under the Apache License, Version 2.0.", "apache"), ("Released under the MIT License.", "mit"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("This work is licensed under the GNU General Public License, version 3.", "gpl")]
    data = [(i, f"thing of the ation\n{t}\nwith er", 0) for i, (t, _) in enumerate(lines)] + [(10, None, 0), (11, "", 0), (12, "the license office of the thing is closed", 0)]
    found = got(op1_licenses.scan(spark.createDataFrame(data, "doc_id long, text string, license int"), op1_licenses.negatives(docs)), "doc_id")
    for i, (_, family) in enumerate(lines):
        assert found[(i,)]["license"] == family and found[(i,)]["confirmed"] and found[(i,)]["paragraph"] == 1
    assert all(not found[(i,)]["confirmed"] for i in (10, 11, 12)) and found[(10,)]["license"] == "none"


def test_licenses_of_one_document(spark, docs):
    """Each licence paragraph is returned, a repeated and an unknown one too; the best stays a column of its own."""
    negatives = op1_licenses.negatives(docs)
    model = op1_licenses.Model(negatives)
    lines = ["thing of the ation", "Released under the MIT License.", "", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Zephyr Public License 1.0.", "Released under the MIT License.", "er"]
    wanted = [(i, *model.one(x)[:3]) for i, x in enumerate(lines) if model.one(x)]
    assert {"mit", "gpl", "unknown"} <= {w[1] for w in wanted} and len(wanted) >= 4
    rows = spark.createDataFrame([(1, "\n".join(lines)), (2, "er"), (3, None)], "doc_id long, text string")
    found = got(op1_licenses.scan(rows, negatives), "doc_id")
    mine = found[(1,)]["paragraphs"]
    assert [(r["paragraph"], r["license"], pytest.approx(r["probability"]), pytest.approx(r["similarity"])) for r in mine] == wanted and found[(1,)]["n_hits"] == len(mine)
    best = max(mine, key=lambda r: (r["confirmed"], r["probability"], -r["paragraph"]))
    assert all(best[k] == found[(1,)][k] for k in ("paragraph", "license", "probability", "similarity", "confirmed"))
    assert found[(2,)]["paragraphs"] == [] and found[(3,)]["paragraphs"] == []


def test_licenses_in_wordings_not_seen(docs):
    """Lead-ins that neither trained nor calibrated; licences of no family; the scan of many texts against the scoring of one paragraph."""
    model = op1_licenses.Model(op1_licenses.negatives(docs))
    leads = ["Published by the town under the {}.", "Everything in this folder is licensed under the {}", "We offer it under the {} only."]
    right = total = 0
    for family, (names, _) in op1_licenses.NAMES.items():
        for lead in leads:
            for name in names:
                said = model.one(lead.format(name))
                total += 1
                right += bool(said and said[0] == family)
                assert not said or said[0] in (family, "unknown") or not said[3] or family in ("gpl", "agpl", "lgpl", "cc-by", "cc-by-nc", "cc-by-sa", "cc0")
    assert right / total > 0.85
    strangers = ["Zephyr Public License 1.0", "Harbour Community License", "NASA Open Source Agreement", "CeCILL", "Q Public License", "Ruby License"]
    assert all(not (said := model.one(lead.format(x))) or (said[0] == "unknown" and not said[3]) for x in strangers for lead in leads)
    assert not any(map(model.one, ["The driver has a license.", "A public path under the old wall.", "", "2.0", "General terms of the lesser foundation"]))
    rng = random.Random(3)
    pool = [lead.format(n) for lead in leads for n, _ in ((x, 0) for ns, _ in op1_licenses.NAMES.values() for x in ns)] + [sentence(rng, "en", 9), "", "All rights reserved.", "  ", "é"]
    texts = ["\n".join(rng.choices(pool, k=rng.randint(0, 9))) for _ in range(60)] + ["", "\n", "MIT License " * 30_000]
    found = model.scan(texts)
    for i, t in enumerate(texts):
        wanted = [(k, said) for k, x in enumerate(t.split("\n")) if (said := model.one(x))]
        assert [(k, f, ok) for k, f, _, _, ok in found.get(i, [])] == [(k, f, ok) for k, (f, _, _, ok) in wanted]
        assert np.allclose([m[2:4] for m in found.get(i, [])], [w[1:3] for _, w in wanted])


def cheapest(roles):
    """The best of all assignments of roles to the turns, by the rules of a legal conversation written out once more."""
    follows = {(0, 1), (0, 2), (1, 2), (2, 3), (3, 2)}
    best = None
    for states in product((1, 2, 3), repeat=len(roles)):
        before, cost, changed = 0, 0, 0
        for role, state in zip(roles, states, strict=True):
            cost += 2 * (role != state)
            if before == state:
                cost, changed = cost + 1, changed + 1
            else:
                changed += role != state
                if (before, state) not in follows:
                    between = [x for x in (1, 2, 3) if (before, x) in follows and (x, state) in follows]
                    if not between:
                        break
                    cost += 3
            before = state
        else:
            cost += 3 * {1: 2, 2: 1, 3: 0}[before]
            best = min(best or (cost, changed, states[::-1]), (cost, changed, states[::-1]))
    return best


def test_role_repair_is_the_best_however_cut():
    for n in range(1, 6):
        for roles in product(range(4), repeat=n):
            cost, _, states = cheapest(roles)
            assert op2_chat.repair(list(roles)) == (list(states[::-1]), cost)
            if n < 4:
                continue
            for cuts in ((1,), (2,), (n - 1,), (1, 3), (2, 3)):
                pieces = [list(roles[a:b]) for a, b in zip((0, *cuts), (*cuts, n), strict=True)]
                plan = op2_chat.chosen([op2_chat.summary(p) for p in pieces])
                got_ = [op2_chat.repair(p, begin, end)[0] for p, (begin, end) in zip(pieces, plan, strict=True)]
                assert sum(got_, []) == list(states[::-1])


def test_repaired_turns_are_legal():
    rng = random.Random(2)
    for _ in range(200):
        roles = rng.choices(range(4), k=rng.randint(1, 9))
        states, _ = op2_chat.repair(roles)
        turns = [x for x in op2_chat.fragments([(i, r, "t") for i, r in enumerate(roles)], states, op2_chat.START, True)]
        kept = [x[2] for x in turns if x[1] not in ("merge", "end")]
        assert re.fullmatch("(system )?(user assistant )+", "".join(f"{k} " for k in kept))


def test_chat_is_alike_in_all_partitions(spark):
    """Conversations over many partitions, repeated rows, a very long text, rows without conv_id."""
    rng = random.Random(6)
    data = [(c, t, rng.choice(["system", "user", "assistant", "bot", None]), f"t{t}") for c in (1, 2, 3, None) for t in range(40)]
    data += [(5, 0, "user", "w " * 200_000)] * 2
    turns = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for n in (1, 3, 40):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            rows = op2_chat.format_chat(spark, turns).collect()
            found.append({c: "".join(r["fragment"] for r in sorted((r for r in rows if r["conv_id"] == c), key=lambda r: r["pos"])) for c in (1, 2, 3, 5, None)})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert found[0] == found[1] == found[2] and found[0][5].count("w ") == 400_000


def test_chat_format(spark):
    data = [(1, 0, "user", "hi"), (1, 1, "user", "there"), (1, 2, "assistant", "<|im_end|>"), (2, 0, "assistant", None), (3, 5, None, "x"), (4, None, "bot", "y")]
    data += [(9, i, "user" if i % 2 == 0 else "assistant", str(i)) for i in range(300)]
    turns = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("action", F.lit(1))
    found = {}
    for r in op2_chat.format_chat(spark, turns).orderBy("conv_id", "pos").collect():
        found[r["conv_id"]] = found.get(r["conv_id"], "") + r["fragment"]
    assert found[1] == "<|im_start|>user\nhi\nthere<|im_end|>\n<|im_start|>assistant\n< |im_end|><|im_end|>\n"
    assert found[9] == "".join(f"<|im_start|>{'user' if i % 2 == 0 else 'assistant'}\n{i}<|im_end|>\n" for i in range(300))
    assert all(re.fullmatch(r"(<\|im_start\|>(system|user|assistant)\n[^<]*<\|im_end\|>\n)*", found[i]) for i in (2, 3, 4))


def test_mixing(spark):
    rng = random.Random(6)
    data, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        data.append((i, " ".join(rng.choices(["rot", "trash", "bla"] if bad else ["fine", "good", "clear", "text"], k=rng.randint(20, 60))), "s"))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1, 0))
    docs = spark.createDataFrame([*data, (900, None, "s"), (901, "", None)], "doc_id long, text string, rate string")
    table = spark.createDataFrame([*labels, (2, None, 0), (5000, 1, 0)], "doc_id long, quality int, toxic int")
    mixed = op10_mixing.mix(spark, docs, table, {"q1_t0": 0.5, "q0_t0": 0.5}).toPandas()
    p = np.array(mixed["posterior"].tolist())
    totals = (mixed["rate"].to_numpy() * mixed["tokens"].to_numpy()) @ p
    assert (mixed["rate"] >= 0).all() and np.allclose(totals / totals.sum(), [0.5, 0.5], atol=0.01)
    assert abs(totals.sum() / mixed["tokens"].sum() - 1) < 0.01
    assert ((mixed["domain"] == "q0_t0") == (mixed["doc_id"] % 4 == 0))[:400].mean() > 0.99


def test_mixing_measures_count_characters(spark):
    texts = ["A Bc DEF 1 22 333", "no such thing", "É Ä ٣ X9", "#*\\[] A1", ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in op10_mixing.featured(docs).collect():
        n = len(r["text"]) + 1
        assert abs(r["_m_capitals"] * n - len(re.findall("[A-Z]", r["text"]))) < 1e-9 and abs(r["_m_digits"] * n - len(re.findall("[0-9]", r["text"]))) < 1e-9
        assert abs(r["_m_symbols"] * n - sum(c in "#*$%&|<>!@=~^{}[]\\_" for c in r["text"])) < 1e-9


def soft_rows(spark, soft):
    """Overlapping posteriors around the shares of four domains, as the mixing fits rates to."""
    rng = np.random.default_rng(0)
    share = np.array([0.25, 0.05, 0.6, 0.1])
    z = rng.normal(size=(4000, 4))
    z[np.arange(4000), rng.choice(4, size=4000, p=share)] += 1.5
    p = np.exp(z * soft) * share
    p /= p.sum(1, keepdims=True)
    t = rng.integers(1, 2000, 4000)
    rows = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(t, p, strict=True)], "tokens long, posterior array<double>").cache()
    return rows, p, t


@pytest.mark.parametrize("soft", [1.0, 0.6])
def test_mixing_of_soft_posteriors(spark, soft):
    rows, p, t = soft_rows(spark, soft)
    names = ["q0_t0", "q0_t1", "q1_t0", "q1_t1"]
    steps = op10_mixing.fit_rates(rows, names, op10_mixing.TARGETS)
    got = op10_mixing.rated(rows, steps).agg(*(F.sum(F.col("rate") * F.col("tokens") * F.col("posterior")[i]) for i in range(4)), F.min("rate")).first()
    assert got[4] >= 0 and np.abs(np.array(got[:4]) / t.sum() - [op10_mixing.TARGETS[n] for n in names]).sum() <= 1e-4


def test_mixing_beyond_reach(spark):
    """Every document is at least a tenth bad: nearest totals are those of the purest document, and a warning gives them."""
    rows = spark.createDataFrame([(100, [0.1 + i / 20, 0.9 - i / 20]) for i in range(9)], "tokens long, posterior array<double>")
    with pytest.warns(UserWarning, match="bad .* for 0.01000"):
        steps = op10_mixing.fit_rates(rows, ["bad", "good"], {"bad": 0.01, "good": 0.99})
    rates = [r["rate"] for r in op10_mixing.rated(rows, steps).orderBy(F.col("posterior")[0]).collect()]
    assert rates[0] > 0 and max(rates[1:]) < 1e-3 * rates[0]


def test_empty_tables(spark, empty):
    assert op4_jaccard_join.join(spark, empty).count() == 0
    assert op8_suffix_dedup.deduplicate(spark, empty, digest=True).count() == 0
    assert op9_quality_rules.quality(spark, empty).count() == 0
    assert op6_bpe.encode_documents(spark, empty, ids=False).count() == 0
    assert op7_token_files.read(op7_token_files.write(spark, empty, Scratch(spark))).count() == 0
    assert op3_language_id.predict(empty, op3_language_id.fit(empty)).count() == 0
    assert op1_licenses.scan(empty, []).count() == 0
    assert op5_ann.search(spark, spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert op2_chat.format_chat(spark, spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert op10_mixing.mix(spark, empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
