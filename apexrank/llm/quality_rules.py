"""Quality rules as a short-circuit cascade whose order follows rejection per cost on a sample. DataFrame functions only."""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, settle, words

#: Rows of the sample on which rules are timed and counted, and how often each is timed.
SAMPLE_ROWS, TIMES = 2000, 2
#: Bits of a run's place in repeat_words(); the others are its hash's.
PLACE = 24


def n_words(text: Column, tokens: Column) -> Column:
    return F.size(tokens).cast("bigint")


def word_chars(text: Column, tokens: Column) -> Column:
    return F.length(F.array_join(tokens, "")).cast("bigint")


def n_symbols(text: Column, tokens: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("bigint")


def n_letters(text: Column, tokens: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{L}+", "")).cast("bigint")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))


def n_lines(text: Column, tokens: Column) -> Column:
    """Lines with a word."""
    return F.size(_lines(text)).cast("bigint")


def n_dup_lines(text: Column, tokens: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(_lines(text), lambda lines: F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint")


def repeat_words(tokens: Column) -> Column:
    """Words that lie in a run of three words found twice or more among tokens, its first place included.

    Most texts repeat no run, which their distinct hashes tell. Else runs are sorted as one number each, the upper bits of the hash over
    PLACE bits of place; should two unlike runs agree in those, or places need more, they are sorted as (hash, place) pairs.
    Neighbours count as equal only once their words agree."""

    def covered(w: Column) -> Column:
        def equal(i: Column, j: Column) -> Column:
            return (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))

        def total(places: Column) -> Column:
            step = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
            return F.aggregate(
                places,
                step,
                lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(a["end"], p)).alias("n")),
                lambda a: a["n"],
            )

        def by_pairs(hashes: Column) -> Column:
            def hits(r: Column) -> Column:
                same = lambda a, b: F.coalesce((a["h"] == b["h"]) & equal(a["i"], b["i"]), F.lit(False))
                return F.sort_array(F.transform(F.filter(r, lambda x, k: same(x, F.get(r, k - 1)) | same(x, F.get(r, k + 1))), lambda x: x["i"]))

            return let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), lambda r: total(hits(r)))

        def by_numbers(hashes: Column) -> Column:
            top = lambda x: F.shiftright(x, PLACE)
            place = lambda x: x.bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int")

            def counted(r: Column) -> Column:
                same = lambda x, k: F.coalesce(top(x) == top(F.get(r, k)), F.lit(False))
                clash = F.exists(F.filter(F.sequence(F.lit(1), F.size(r) - 1), lambda k: same(F.get(r, k), k - 1)), lambda k: ~equal(place(F.get(r, k)), place(F.get(r, k - 1))))
                hits = F.sort_array(F.transform(F.filter(r, lambda x, k: same(x, k - 1) | same(x, k + 1)), place))
                return F.when(clash, by_pairs(hashes)).otherwise(total(hits))

            return let(F.sort_array(F.transform(hashes, lambda h, i: F.shiftleft(top(h), PLACE).bitwiseOR(i.cast("bigint")))), counted)

        def repeated(hashes: Column) -> Column:
            once = F.size(F.array_distinct(hashes)) == F.size(hashes)
            return F.when(once, F.lit(0)).when(F.size(hashes) >= 1 << PLACE, by_pairs(hashes)).otherwise(by_numbers(hashes))

        return let(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))), repeated)

    return F.when(F.size(tokens) < 4, F.lit(0)).otherwise(let(tokens, covered)).cast("bigint")


def n_repeat_words(text: Column, tokens: Column) -> Column:
    return repeat_words(tokens)


@dataclass(frozen=True)
class Rule:
    """fails(stat) tells whether a text is rejected; stat(name) gives a statistic of it."""

    name: str
    fails: object


#: Each statistic of a text, by the text and its words, which all share.
STATS = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_letters": n_letters, "n_lines": n_lines, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words}
BASE_RULES = (
    Rule("few_words", lambda s: s("n_words") < 50),
    Rule("repeats", lambda s: 100 * s("n_repeat_words") > 50 * s("n_words")),
)
RULES = (
    Rule("symbols", lambda s: 100 * s("n_symbols") > 50 * s("n_words")),
    Rule("word_length", lambda s: (s("word_chars") < 2 * s("n_words")) | (s("word_chars") > 20 * s("n_words"))),
    Rule("few_letters", lambda s: 100 * s("n_letters") < 50 * s("word_chars")),
    Rule("dup_lines", lambda s: 100 * s("n_dup_lines") > 50 * s("n_lines")),
)


def _stat(text: Column, tokens: Column, ready=()):
    """Statistics by name: those that are columns already, others computed where they are asked for."""
    return lambda name: F.col(name) if name in ready else STATS[name](text, tokens)


def ordered(docs: DataFrame, rules=BASE_RULES + RULES, ready=(), seed: int = 7) -> list[tuple[Rule, float, float]]:
    """Rules by rejections per cost on a sample, with their cost (seconds a row, to the next power of two) and selectivity. Words
    and the statistics called ready are there before, so they cost a rule nothing; nor does what a rule without work takes,
    which is timed as well. The order decides what is spared, never the verdict; on an empty table rules keep their order."""
    rows = docs.count()
    if not rows:
        return [(r, 0.0, 0.0) for r in rules]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(text.alias("t")).sample(min(1.0, SAMPLE_ROWS / rows), seed=seed).select("t", words(F.col("t")).alias("w"))
    stat = _stat(F.col("t"), F.col("w"))
    sample = settle(texts.select("t", "w", *[stat(name).alias(name) for name in ready]), "sample").cache()
    drawn = max(1, sample.count())

    def timed(fails: Column) -> tuple[float, int]:
        job, took, rejected = sample.agg(F.count_if(fails)), [], 0
        for _ in range(TIMES + 1):  # the first compiles
            began = time.perf_counter()
            rejected = job.first()[0]
            took.append(time.perf_counter() - began)
        return min(took[1:]), rejected

    empty, _ = timed(F.length("t") + F.size("w") < 0)
    found = []
    for rule in rules:
        took, rejected = timed(rule.fails(_stat(F.col("t"), F.col("w"), ready)))
        found.append((rule, 2.0 ** math.ceil(math.log2(max(took - empty, 1e-3) / drawn)), rejected / drawn))
    sample.unpersist()
    return sorted(found, key=lambda x: (-x[2] / x[1], x[1], x[0].name))


def verdict(rules, stat) -> Column:
    """True for what no rule rejects; later rules are only evaluated where no earlier one has."""
    out = None
    for rule in rules:
        failed = F.coalesce(rule.fails(stat), F.lit(False))
        out = F.when(failed, F.lit(False)) if out is None else out.when(failed, F.lit(False))
    return out.otherwise(F.lit(True))


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of docs (with a text column) that no rule rejects, columns unchanged, whatever their names. A null text counts as empty
    and is rejected, as it has fewer than 50 words; a very long one is read whole. Repeated rows share their fate; an empty table
    gives none. A text is split into words once; the rules share them, and a rejection spares the statistics of the rules behind it."""
    rules = [r for r, _, _ in ordered(docs)]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.where(let(words(text), lambda w: verdict(rules, _stat(text, w))))


def score_quality(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for each row of docs (doc_id, text).

    Null and empty texts have no words: all counts are 0, base_failed is true. Very long texts are counted whole. Rows are
    independent, so repeated rows and repeated or null doc_ids are returned each; other columns are ignored; an empty table
    gives none. What is not returned (lines, letters) is counted only where neither the base nor an earlier rule rejects."""
    ready = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rules = [r for r, _, _ in ordered(docs, RULES, ready)]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = docs.select("doc_id", text.alias("_text"), words(text).alias("_words"))
    stat = _stat(F.col("_text"), F.col("_words"))
    counted = split.select("doc_id", "_text", "_words", *[stat(name).alias(name) for name in ready])
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(rules, _stat(F.col("_text"), F.col("_words"), ready)))
    return counted.withColumn("base_failed", base).select("doc_id", *ready, "base_failed", kept.alias("kept"))
