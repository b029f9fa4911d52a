"""Text functions as Catalyst expressions: sentences, claims, tokens, grams, prompts and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Words whose period ends no sentence.
ABBREVIATIONS = """
mr mrs ms mss dr prof rev hon sr jr st vs etc al
e.g i.e cf ca approx est no nos fig figs eq eqs
inc ltd co corp llc plc dept div univ assn bros
vol vols pp ch chs sec secs ed eds trans repr
jan feb mar apr jun jul aug sept sep oct nov dec
mon tue tues wed thu thurs fri sat sun
u.s u.k e.u a.m p.m ph.d b.a m.a m.d d.c
""".split()
#: Words that search ignores.
STOPWORDS = """
a an the and or but if then than that this these those of to in on at by
for with from as is are was were be been being it its
""".split()
#: Fixed patterns of sentences that state nothing, and of source-naming openings.
SCAFFOLDS = (
    r"here(?:'s|\s+(?:is|are))\b.*",
    r"the\s+(?:context|documents?|sources?|passages?|excerpts?)\b.{0,60}(?:does\s+not|do\s+not|don't|doesn't|never)\b.*",
    r"i\s+(?:hope|can|could|cannot|can't|don't|do\s+not|was|am)\b.*",
    r"let\s+me\s+know\b.*",
    r"\W*",
)
SOURCE_OPENING = r"^(?:based\s+on|according\s+to)\s+(?:the\s+)?(?:provided\s+|given\s+|supplied\s+)?(?:context|documents?|sources?|passages?|excerpts?)\s*[,;:\-—]\s*"
TOKEN = r"[a-z0-9][a-z0-9'_-]*"

CLOSERS = "[\"')\\]”’]"
_ABBREVIATED = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
#: A run of terminators and closers of any length, the white space after it, and what goes before a new sentence.
TERMINATED = rf"[.!?]+{CLOSERS}*(?U:\s)+(?=(?U:[^\s\p{{Ll}}]))"
#: A piece that an abbreviation or an initial ends, so that the next piece goes on with its sentence.
UNFINISHED = rf"(?:^|[^A-Za-z.])\.*(?i:{_ABBREVIATED}|[a-z])\.[.!?]*{CLOSERS}*(?U:\s)*$"


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def sentence_spans(text: Column) -> Column:
    """Array of (text, start, end): trimmed sentences with code-point offsets.

    Each terminated run gets a mark behind its white space, by which the text is cut; no look-behind bounds how long a run may be. A piece that
    an abbreviation ends goes on with the next.
    """
    cut = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), f"({TERMINATED})", "$1\x00\uffff"), "\x00\uffff")
    # The outer array has the pieces cut once; the last one ends a sentence in any case.
    pieces = F.element_at(F.transform(F.array(cut), lambda ps: F.transform(ps, lambda p, i: F.struct(p.alias("p"), ((i == F.size(ps) - 1) | ~p.rlike(UNFINISHED)).alias("done")))), 1)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("held"), F.array().cast("array<struct<text:string,start:int,end:int>>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        piece = F.concat(acc["held"], x["p"])
        lead = F.char_length(piece) - F.char_length(F.regexp_replace(piece, r"(?U)^\s+", ""))
        body = strip(piece)
        start = acc["at"] + lead
        span = F.struct(body.alias("text"), start.alias("start"), (start + F.char_length(body)).alias("end"))
        at = F.when(x["done"], acc["at"] + F.char_length(piece)).otherwise(acc["at"])
        out = F.when(~x["done"] | (body == ""), acc["out"]).otherwise(F.concat(acc["out"], F.array(span)))
        return F.struct(at.alias("at"), F.when(x["done"], F.lit("")).otherwise(piece).alias("held"), out.alias("out"))

    return F.aggregate(pieces, zero, add, lambda acc: acc["out"])


def sentences(text: Column) -> Column:
    return F.transform(sentence_spans(text), lambda s: s["text"])


def sentence_table(docs: DataFrame, *keys: str) -> DataFrame:
    """One row for each sentence: keys, sent_ord, text, start, end, n_words."""
    spans = docs.select(*keys, F.posexplode(sentence_spans(F.col("text"))).alias("sent_ord", "s"))
    return spans.select(*keys, "sent_ord", "s.text", "s.start", "s.end", word_count(F.col("s.text")).alias("n_words"))


def carries_a_claim(sentence: Column) -> Column:
    """Whether a sentence states something: no scaffolding, three words at least after a source opening."""
    body = strip(F.regexp_replace(strip(sentence), f"(?iU){SOURCE_OPENING}", ""))
    empty = F.coalesce(body, F.lit("")) == ""
    return ~empty & ~body.rlike(f"(?isU)^(?:{'|'.join(SCAFFOLDS)})$") & (word_count(body) >= 3)


def tokenize(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.filter(words, lambda w: ~F.array_contains(F.array(*map(F.lit, STOPWORDS)), w))


def gram_text(text: Column) -> Column:
    """Lower-case letters and digits joined by single spaces, a space at each end."""
    return F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), " "), F.lit(" "))


def grams(padded: Column, sizes: tuple[int, ...] = (3, 4, 5)) -> Column:
    """All character grams of the sizes, with repeats."""

    def of(n: int) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substr(padded, i, F.lit(n)))
        return F.when(F.length(padded) >= n, cut).otherwise(F.array().cast("array<string>"))

    return F.concat(*map(of, sizes))


def title(text: Column, fallback: Column) -> Column:
    """The first non-blank line without leading # signs, cut to 120 characters."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: strip(F.regexp_replace(strip(x), "^#+", ""))), lambda x: x != "")
    return F.coalesce(F.left(F.get(lines, F.lit(0)), F.lit(120)), fallback)


def excerpt(text: Column, limit: int = 220) -> Column:
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(F.left(text, F.lit(limit - 1)), r"(?U)\s+$", ""), F.lit("…")))


def english_list(names: Column) -> Column:
    """a, b and c; nothing for no names."""
    n = F.size(names)
    return F.when(n == 0, "nothing").when(n == 1, F.get(names, F.lit(0))).otherwise(F.concat(F.array_join(F.slice(names, F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at(names, -1)))


def folded(text: Column) -> Column:
    return F.lower(strip(F.regexp_replace(text, r"(?U)\s+", " ")))


WITH_EVIDENCE = "Answer from the numbered excerpts where they help and from general knowledge elsewhere, in at most five plain sentences, without mentioning the excerpts."
WITHOUT_EVIDENCE = "Answer from general knowledge in at most five plain sentences, without saying what you were given."
INSERTION = "Insert one plausible, specific, unsupported sentence into the passage and change nothing else.\n\n"


def prompt(question: Column, texts: Column) -> Column:
    """The question alone, or excerpts numbered from 1 and then the question."""
    listed = F.transform(texts, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), strip(t), F.lit("\n\n")))
    return F.when(F.size(texts) == 0, strip(question)).otherwise(F.concat(F.lit("Excerpts:\n\n"), F.array_join(listed, ""), F.lit("Question: "), strip(question)))


def system_for(texts: Column) -> Column:
    return F.when(F.size(texts) == 0, WITHOUT_EVIDENCE).otherwise(WITH_EVIDENCE)


def insertion_prompt(answer: Column) -> Column:
    return F.concat(F.lit(INSERTION), strip(answer))


def request_key(system: Column, text: Column, model: str = "scripted", max_tokens: int = 600) -> Column:
    """40 hex digits that name a request; fields in alphabetical order, joined by a unit separator."""
    return F.left(F.sha2(F.concat_ws("\x1f", F.lit(str(max_tokens)), F.lit(model), text, system, F.lit("0.0")), 256), F.lit(40))


def vector_key(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(32))


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """An ordinal over a small table (questions, chunks of one question); not for the corpus."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)
