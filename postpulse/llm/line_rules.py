"""Quality rules, lines first: clean the lines, then judge what is left. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postpulse.llm.common import named

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
REPEATED = 5  # words of a window that may repeat

# Phrases that stand in boilerplate lines, whatever the page is about (fixed values).
BOILERPLATE = (
    "all rights reserved", "accept cookies", "cookie policy", "cookie settings", "privacy policy",
    "terms of use", "terms of service", "terms and conditions", "javascript", "lorem ipsum",
    "licensed under", "released under the", "subscribe to our", "sign up for our",
    "click here", "read more", "skip to content", "powered by", "follow us on", "share this",
)


@dataclass(frozen=True)
class LineRules:
    """Limits of the rules. A line fails by the first rule that holds.

    - boilerplate: it holds one of ``phrases`` (without regard to case) and has at most
      ``phrase_words`` words;
    - navigation: over ``bars`` of its words are single separator signs, or begin with one;
    - punctuation: over ``signs`` of its words end in a symbol or in doubled ``!`` or ``?``, or
      it has no sentence end at all and at most ``short`` words.

    A document is rejected if over ``lost`` of its words outside boilerplate stood in lines that
    failed, or if no word is left. (Boilerplate goes from the text, but says nothing about the rest.)
    """

    phrases: tuple[str, ...] = BOILERPLATE
    phrase_words: int = 40
    bars: float = 0.2
    signs: float = 0.25
    short: int = 12
    lost: float = 0.5


def _bracket(text: str) -> str:
    return "".join("\\" + c for c in text)


def words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def failed_rule(line: Column, n: Column, rules: LineRules) -> Column:
    """Name of the rule by which a line of ``n`` words fails; null if it stays."""
    low = F.lower(line)
    phrase = F.lit(False)
    for p in rules.phrases:
        phrase = phrase | low.contains(p)
    # The sign first: what stands before it is only looked at where there is one.
    bars = F.regexp_count(line, F.lit(r"(?s)[|»›•·>](?<![^\x20\x09-\x0D].)"))
    loud = F.regexp_count(line, F.lit(rf"(?:[{_bracket(SYMBOLS)}]|[!?]{{2}}),?(?![^\x20\x09-\x0D])"))
    ended = line.rlike(r"[.!?…。！？؟।][\"'”’»)\]]*(?:[\x20\x09-\x0D]|$)")
    return (F.when((n <= rules.phrase_words) & phrase, "boilerplate")
            .when(bars > n * rules.bars, "navigation")
            .when((loud > n * rules.signs) | ((n <= rules.short) & ~ended), "punctuation"))


def runs_of(flat: Column, width: int = REPEATED) -> Column:
    """All runs of ``width`` words of a text with single spaces, in order, by one pattern."""
    words = " ".join(["[^ ]++"] * width)
    return F.regexp_extract_all(flat, F.lit(rf"\G ?(?=({words}))[^ ]++"), F.lit(1))


def repeated_words(runs: str, n: str, width: int = REPEATED) -> Column:
    """Words that stand in a run found twice or more, of ``n`` runs.

    Sorted with their places, equal runs meet as neighbours; then the places are put in order,
    and each adds the words up to the next place, ``width`` at most.
    """
    placed = F.sort_array(F.transform(runs, lambda r, i: F.struct(r.alias("r"), i.alias("i"))))
    none = F.expr("CAST(array() AS array<int>)")
    ahead = F.slice(placed, F.lit(2), F.col(n))
    twins = F.zip_with(placed, ahead, lambda a, b: F.when(
        a["r"] == b["r"], F.array(a["i"], b["i"])).otherwise(none))
    places = F.sort_array(F.array_distinct(F.flatten(twins)))
    # Sums of the gaps: the places of a run begin a stretch of width words.
    return F.aggregate(
        places, F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-width).alias("last")),
        lambda s, p: F.struct((s["sum"] + F.least(p - s["last"], F.lit(width))).alias("sum"), p.alias("last")),
        lambda s: s["sum"])


def clean_lines(docs: DataFrame, rules: LineRules = LineRules(), key: str = "doc_id",
                text: str = "text") -> DataFrame:
    """Cleaned text and verdict of every document.

    Words are ``[^\\x20\\x09-\\x0D]+``, lines the parts between ``\\n``. Each line is judged by itself;
    lines that fail are removed, lines without a word stay and count nothing. What is left is
    judged then: a document is rejected if it lost over ``rules.lost`` of its words that aren't
    boilerplate, and at once if it has under 10 words or over 20 of 100 stand in repeated runs
    of five (``base_failed``).

    Output, one row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, clean_text, n_lines, n_boilerplate, n_navigation,
    n_punctuation (lines removed by each rule), n_words_left. Null text: no words, null
    clean_text, base_failed; empty text alike with an empty clean_text. Repeated rows and
    null keys are judged like any other; an empty table gives an empty one. Other columns aren't
    read, whatever their names.

    Every row is worked on by itself, without a shuffle; memory follows the longest text (some
    eight times its size while repeated runs are looked for).
    """
    rows = docs.select(named(key).alias("doc_id"), named(text).cast("string").alias("t"))
    # Each step is a column of its own, so that no later one works it out again.
    flat = F.trim(F.regexp_replace("t", SPACES, " "))
    rows = rows.withColumn("runs", runs_of(flat)).withColumn("n_runs", F.size("runs"))
    rows = rows.withColumn("again", F.size(F.array_distinct("runs")) < F.col("n_runs"))
    repeats = F.when(F.col("again"), repeated_words("runs", "n_runs"))
    rows = rows.withColumn("n_repeat_words", F.coalesce(repeats, F.lit(0))).drop("runs", "n_runs", "again")
    # Each line with its words and the rule by which it fails.
    judged = F.transform(F.split("t", "\n"), lambda x: F.struct(
        x.alias("line"), words_in(x).cast("long").alias("n")))
    judged = F.transform(judged, lambda s: F.struct(
        s["line"].alias("line"), s["n"].alias("n"),
        F.when(s["n"] > 0, failed_rule(s["line"], s["n"], rules)).alias("rule")))
    rows = rows.withColumn("lines", judged)
    words = lambda keep: F.coalesce(F.aggregate(
        F.filter("lines", keep), F.lit(0).cast("long"), lambda s, x: s + x["n"]), F.lit(0))
    fails = lambda name: F.coalesce(
        F.size(F.filter("lines", lambda x: x["rule"] == name)), F.lit(0))
    bare = F.length(F.translate("t", " \t\n\x0b\x0c\r", ""))
    symbols = F.regexp_count("t", F.lit(f"[{_bracket(SYMBOLS)}]"))
    rows = rows.withColumns({
        "n_words": words(lambda x: x["n"] > 0),
        "n_words_left": words(lambda x: x["rule"].isNull()),
        "n_body": words(lambda x: x["rule"].isNull() | (x["rule"] != "boilerplate")),
        "worded": F.transform(F.filter("lines", lambda x: x["n"] > 0), lambda x: x["line"]),
        "word_chars": F.coalesce(bare.cast("long"), F.lit(0)),
        "n_symbols": F.coalesce(symbols.cast("long"), F.lit(0)),
    })
    doubled = F.size("worded") - F.size(F.array_distinct("worded"))
    rows = rows.withColumn("n_dup_lines", F.when(F.col("t").isNull(), F.lit(0)).otherwise(doubled).cast("long"))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    lost = (F.col("n_body") - F.col("n_words_left") > F.col("n_body") * F.lit(rules.lost)) \
        | (F.col("n_words_left") == 0)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & ~lost).alias("kept"),
        F.array_join(F.transform(F.filter("lines", lambda x: x["rule"].isNull()),
                                 lambda x: x["line"]), "\n").alias("clean_text"),
        F.coalesce(F.size(F.col("lines")), F.lit(0)).alias("n_lines"),
        *[fails(r).alias(f"n_{r}") for r in ("boilerplate", "navigation", "punctuation")],
        "n_words_left",
    )
