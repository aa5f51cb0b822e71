"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A document is kept if no rule rejects it, so the verdict doesn't depend on the order of the rules; the cost does. What
each rule costs and how often it rejects is estimated on a sample, all rules in one aggregation, and the rules are tried in
order of rejections per cost: one CASE expression stops at the first rule that rejects. A rule states its cost in
characters looked at (``work``), so the order follows from the texts and not from a clock: rules over numbers cost next to
nothing, those that read every word or line are worked out only for documents that no rule before them rejected.

Defined results: a null or word-less text has no words and fails the base rule. Very long texts are handled whole.
Rows that repeat an id are judged each by itself. Only id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.session import Scratch

WHITE = r"[\x20\x09-\x0D]+"
WHITE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a SQL condition over text and the columns of :func:`base_features`, ``work`` what it costs to test."""

    name: str
    rejects: str
    work: str = "1"


# Starting a pattern on a word or a line counts as twelve characters, hashing a word as four.
RULES = (
    Rule("symbol_density", "10 * n_symbols > n_words"),
    Rule("word_length", "2 * word_chars < 5 * n_words OR word_chars > 12 * n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("letterless_words", r"10 * size(filter(words, w -> NOT w RLIKE '\\p{L}')) > 3 * n_words", "12 * n_words"),
    Rule("upper_case_words", r"10 * size(filter(words, w -> w RLIKE '\\p{Lu}' AND NOT w RLIKE '\\p{Ll}')) > 6 * n_words", "12 * n_words + word_chars"),
    Rule("few_different_words", "50 * size(array_distinct(words)) < n_words", "4 * n_words + word_chars"),
    Rule("overlong_word", "exists(words, w -> length(w) > 1000)", "n_words + word_chars"),
    Rule("bullet_lines", r"10 * size(filter(lines, x -> x RLIKE '^[ \\t]*[-*\u2022\u00b7]')) > 9 * n_lines", "12 * n_lines"),
    Rule("cut_off_lines", r"10 * size(filter(lines, x -> x RLIKE '(\\.\\.\\.|\u2026)[ \\t\\r]*$')) > 3 * n_lines", "12 * n_lines + length(text)"),
)


def _repeat_words(frame: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in a window of five that the text has twice or more.

    Texts without a repeated window, most of them, stop at the comparison of distinct window hashes. The others sort
    (hash, start), keep the starts whose neighbour has the same hash, and add up what those windows cover.
    """
    starts = F.sequence(F.lit(0), F.size("words") - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)]))
    frame = frame.withColumn("hashes", F.when(F.size("words") >= WINDOW, hashes))
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    order = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    frame = frame.withColumn("order", F.when(repeats, order))
    same = lambda s, k: F.coalesce(s.h == F.get("order", k - 1).h, F.lit(False)) | F.coalesce(s.h == F.get("order", k + 1).h, F.lit(False))
    frame = frame.withColumn("again", F.sort_array(F.transform(F.filter("order", same), lambda s: s.i)))
    covered = F.transform("again", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("again", k + 1) - x, F.lit(WINDOW))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return frame.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("hashes", "order", "again")


def base_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, words, lines and the base columns of every text."""
    frame = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    frame = frame.withColumn("words", F.filter(F.split("text", WHITE), lambda w: w != ""))
    frame = frame.withColumn(
        "lines", F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(WHITE_CHARS)) != "")
    )
    frame = frame.select(
        "id",
        "text",
        "words",
        "lines",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("text", WHITE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    return _repeat_words(frame).withColumn(
        "base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    )


def rule_order(sample: DataFrame, rules: tuple[Rule, ...] = RULES) -> list[tuple[Rule, float, float]]:
    """Rules with mean work and rejected share on the sample, best rejection per work first; ties by work, then by name."""
    parts = [x for r in rules for x in (F.avg(F.expr(r.work).cast("double")), F.avg(F.expr(r.rejects).cast("int")))]
    row = sample.agg(*[p.alias(str(i)) for i, p in enumerate(parts)]).first()
    measured = [(rule, max(row[2 * i] or 0.0, 1.0), row[2 * i + 1] or 0.0) for i, rule in enumerate(rules)]
    return sorted(measured, key=lambda m: (-m[2] / m[1], m[1], m[0].name))


def work_done(rows: DataFrame, rules: list[Rule]) -> float:
    """Work of a cascade that tries ``rules`` in this order and stops at the first that rejects, over all rows."""
    total, still = F.lit(0.0), F.lit(True)
    for rule in rules:
        total = total + F.when(still, F.expr(rule.work).cast("double")).otherwise(0.0)
        still = still & ~F.expr(rule.rejects)
    return rows.agg(F.sum(total)).first()[0] or 0.0


def quality_cascade(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: tuple[Rule, ...] = RULES,
    sample_rows: int = 2000,
) -> DataFrame:
    """The base columns of each row, with kept and rejected_by (``base``, the rule that the cascade stopped at, or null).

    The order of the rules is estimated on a random sample of about ``sample_rows`` rows, those that pass the base rule;
    all rows are judged.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    share = sample_rows / max(1, docs.count())
    sample = docs if share >= 1 else docs.sample(share, seed=1)  # a limit would gather rows of every partition in one task
    sample = scratch.write(base_features(sample, id_col, text_col), "sample")
    order = rule_order(sample.filter("NOT base_failed"), rules)
    verdict = F.when(F.col("base_failed"), F.lit("base"))
    for rule, _, _ in order:
        verdict = verdict.when(F.expr(rule.rejects), F.lit(rule.name))
    found = base_features(docs, id_col, text_col).withColumn("rejected_by", verdict)
    # written, as a filter of the caller would else be moved below the word arrays and work them out for each use
    result = found.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.col("rejected_by").isNull().alias("kept"), "rejected_by",
    )
    result = scratch.write(result, "result")
    scratch.drop("sample")
    return result
