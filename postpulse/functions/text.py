"""Text cleaning and tokenising. No Python UDF: everything stays in the JVM."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Sequence
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from postpulse.constants import (
    EDGE_CHARS,
    HANDLE_OR_TAG,
    NEVER_TOKENS,
    PUNCTUATION,
    URL_TAIL,
    WHITESPACE,
)

# Java's Unicode \w also takes combining marks, so word characters are spelt out.
_WORD = r"\p{L}\p{N}_"
# A URL can only begin where a run of word characters begins or where the match
# before it ended; saying so keeps the search linear in the length of the text.
_URL = rf"(?:\G|(?<![{_WORD}]))[{_WORD}]++://{URL_TAIL}"
_HANDLE_OR_URL = f"{HANDLE_OR_TAG}|{_URL}"
# One pass blanks handles, URLs, runs of punctuation and any other non-word character.
_MARKS = f"{PUNCTUATION}+|[^{_WORD} ]"
# Signs that are never blanked, as single ones of Latin-1: Java looks them up in a table, ranges are compared one by one.
_KEPT = "[" + "".join(c for c in map(chr, range(0x100)) if c.isalnum() or c == " ") + "]"


def _replace(col: Column | str, with_url: str, without_url: str, by: str) -> Column:
    """Replace a pattern; texts without any URL take the cheaper form of it."""
    text = F.col(col) if isinstance(col, str) else col
    return F.when(text.contains("://"), F.regexp_replace(text, with_url, by)).otherwise(
        F.regexp_replace(text, without_url, by)
    )


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(from, to, multi) for stripping accents, derived from the Unicode database.

    Characters of ``from`` beyond the length of ``to`` are deleted. ``multi`` holds
    the few characters whose plain form is longer than one character.
    """
    mapped, deleted, multi = [], [], []
    for code in range(sys.maxunicode + 1):
        char = chr(code)
        mark = unicodedata.category(char) == "Mn"
        if not mark and not unicodedata.decomposition(char):
            continue
        kept = "".join(
            c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn"
        )
        plain = unicodedata.normalize("NFC", kept)
        if plain == char:
            continue
        if not plain:
            deleted.append(char)
        elif len(plain) == 1:
            mapped.append((char, plain))
        else:
            multi.append((char, plain))
    source = "".join(a for a, _ in mapped) + "".join(deleted)
    return source, "".join(b for _, b in mapped), tuple(multi)


def strip_accents(col: Column | str, origin: Column | str | None = None) -> Column:
    """Remove combining marks, also those inside composed characters (``ñ`` -> ``n``).

    What is left is composed again: letters stored as separate parts other than combining marks
    (decomposed Hangul, vowel signs in two parts) come out as one character.

    Text of ASCII only is left alone. When ``col`` is a long expression, give as
    ``origin`` the column it is made from, so the test does not evaluate it again. Without one an
    expression is worked out once, as the value of a lambda.
    """
    if origin is None and not isinstance(col, str):
        return F.get(F.transform(F.array(col), lambda c: strip_accents(c, c)), F.lit(0))
    text = F.col(col) if isinstance(col, str) else col
    source, target, multi = _accent_table()
    spelled = reduce(lambda c, m: F.replace(c, F.lit(m[0]), F.lit(m[1])), multi, text)
    ascii_only = _is_ascii(text if origin is None else origin)
    bare = F.translate(spelled, source, target)
    return F.when(ascii_only, text).otherwise(composed(bare, text if origin is None else origin))


# First and last leading consonant, vowel, trailing consonant, and syllable of Hangul (fixed values).
_LEAD, _VOWEL, _TAIL, _SYLLABLE = (0x1100, 0x1112), (0x1161, 0x1175), (0x11A8, 0x11C2), (0xAC00, 0xD7A3)
_VOWELS, _TAILS = 21, 28  # vowels for each consonant; endings for each pair of them, with none


@lru_cache(maxsize=1)
def _joined_parts() -> tuple[tuple[str, str], ...]:
    """(parts, character) of composed characters without combining marks, from the Unicode database.

    Hangul isn't among them, which is composed by arithmetic.
    """
    found = []
    for code in range(sys.maxunicode + 1):
        char = chr(code)
        if not unicodedata.decomposition(char) or unicodedata.normalize("NFC", char) != char:
            continue
        parts = unicodedata.normalize("NFD", char)
        if len(parts) > 1 and not any(unicodedata.category(c) == "Mn" for c in parts):
            found.append((parts, char))
    return tuple(found)


def composed(text: Column, origin: Column | str) -> Column:
    """Canonical composition of a text without combining marks.

    Only texts whose ``origin`` holds a part that can be joined to what stands before it are looked
    into; all others are left as they are. Parts of Hangul syllables are joined by their numbers, in
    one pass over the text.
    """
    pairs, raw = _joined_parts(), F.col(origin) if isinstance(origin, str) else origin
    seconds = "".join(sorted({p[-1] for p, _ in pairs}))
    jamo = "{}-{}{}-{}".format(*map(chr, (*_VOWEL, *_TAIL)))

    # Two ranges tell most texts at once; the many single signs are slower to look for.
    planes = [sorted(c for c in seconds + chr(_VOWEL[0]) if (c > "\uffff") == far) for far in (False, True)]
    wide = "".join(f"{p[0]}-{p[-1]}" for p in planes if p)

    def one(x: Column) -> Column:
        joined = reduce(lambda c, m: F.replace(c, F.lit(m[0]), F.lit(m[1])), pairs, x)
        found = raw.rlike(f"[{wide}]") & raw.rlike(f"[{jamo}{seconds}]")
        return F.when(found, _syllables(joined)).otherwise(x)

    # As a lambda over one value: the long expression, rarely needed, stays out of the compiled code
    # of all other texts, and ``text`` is worked out once.
    return F.get(F.transform(F.array(text), one), F.lit(0))


@lru_cache(maxsize=1)
def _syllable_signs() -> tuple[str, str]:
    """(pattern, syllables): what Hangul text is cut into, and all syllables by their number."""
    # Ranges only: a class of many single signs is looked through one by one for each character.
    lead, vowel, tail, made = ("{}-{}".format(*map(chr, ends)) for ends in (_LEAD, _VOWEL, _TAIL, _SYLLABLE))
    pattern = f"(?s)[{lead}][{vowel}][{tail}]?|[{made}][{tail}]|[^{lead}{made}]+|."
    return pattern, "".join(map(chr, range(_SYLLABLE[0], _SYLLABLE[1] + 1)))


def _syllables(text: Column) -> Column:
    """Parts of Hangul syllables joined by their numbers.

    The text is cut into what makes one syllable and all that stands between; only the former is
    looked at more closely, and its syllable is taken by number from the list of all.
    """
    pattern, every = _syllable_signs()
    listed = F.split(F.lit(every), "")
    code = lambda c, at: F.ascii(F.substring(c, at, 1))
    # Endings are numbered from 1; where there is none, the code of the empty text is 0.
    ending = lambda c: F.greatest(c - (_TAIL[0] - 1), F.lit(0))

    def made(run: Column) -> Column:
        first, second = F.ascii(run), code(run, 2)
        pair = ((first - _LEAD[0]) * _VOWELS + (second - _VOWEL[0])) * _TAILS + ending(code(run, 3))
        return (F.when(second.between(*_VOWEL) & first.between(*_LEAD), F.get(listed, pair))
                .when(second.between(*_TAIL) & first.between(*_SYLLABLE) & ((first - _SYLLABLE[0]) % _TAILS == 0),
                      F.get(listed, first - _SYLLABLE[0] + ending(second)))
                .otherwise(run))

    runs = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.transform(runs, made), "")


def _is_ascii(col: Column | str) -> Column:
    return F.octet_length(col) == F.char_length(col)


def strip_handles_urls(col: Column | str) -> Column:
    """Delete handles, tags and URLs, leaving everything else."""
    return _replace(col, _HANDLE_OR_URL, HANDLE_OR_TAG, "")


def plain_text(col: Column | str) -> Column:
    """The cleaned text that ``words_of`` splits: words with one blank or more between them."""
    # Without URLs nothing to blank begins with a letter, digit or space.
    blanked = _replace(
        col,
        f"{_HANDLE_OR_URL}|{_MARKS}",
        f"(?!{_KEPT})(?:{HANDLE_OR_TAG}|{_MARKS})",
        " ",
    )
    # Only letters are left, so the one-to-one part of the accent table is enough, and
    # the digits go in the same pass.
    source, target, _ = _accent_table()
    bare = F.translate(blanked, source[: len(target)] + "0123456789", target)
    return F.lower(F.when(_is_ascii(col), F.regexp_replace(blanked, "[0-9]+", "")).otherwise(composed(bare, col)))


def normalize_text(col: Column | str) -> Column:
    """Plain lower-case words: no handles, tags, URLs, punctuation, digits or accents."""
    return F.regexp_replace(plain_text(col), " {2,}", " ")


def split_words(col: Column | str) -> Column:
    """Split on any Unicode whitespace; edges may give empty strings."""
    return F.split(col, WHITESPACE)


def _not_counted(stopwords: Sequence[str]) -> list[str]:
    return sorted({*stopwords, *NEVER_TOKENS})


def words_of(col: Column | str) -> Column:
    """Distinct words of a post before stop words are dropped; may hold ''."""
    return distinct_words(plain_text(col))


def distinct_words(plain: Column | str) -> Column:
    """``words_of`` from the ``plain_text``."""
    return F.array_distinct(F.split(plain, " "))


def is_counted(word: Column, stopwords: Sequence[str] = ()) -> Column:
    """Stop-word membership test: true for words that count."""
    return ~word.isin(_not_counted(stopwords))


def tokens(col: Column | str, stopwords: Sequence[str] = ()) -> Column:
    """Distinct counted words of a post."""
    return F.filter(words_of(col), lambda w: is_counted(w, stopwords))


def tokens_edge_trim(col: Column | str, stopwords: Sequence[str] = ()) -> Column:
    """Earlier tokeniser: only token edges are trimmed, inner marks and digits stay."""
    plain = strip_accents(F.lower(strip_handles_urls(col)), origin=col)
    trimmed = F.transform(split_words(plain), lambda w: F.btrim(w, F.lit(EDGE_CHARS)))
    return F.array_distinct(F.filter(trimmed, lambda w: is_counted(w, stopwords)))


def tokens_alpha(col: Column | str, shortest: int = 5, longest: int = 40) -> Column:
    """Runs of letters within a length range, in order, duplicates kept."""
    plain = strip_accents(F.lower(col), origin=col)
    runs = F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{Nl}\p{No}_]+"), 0)
    return F.filter(
        runs,
        lambda w: F.char_length(w).between(shortest, longest) & ~w.startswith("_"),
    )


def strip_first(col: Column | str) -> Column:
    """Drop the first character, whatever it is (handle -> name)."""
    return F.substring(col, 2, 2**31 - 1)


def hashtags(col: Column | str) -> Column:
    """Words starting with ``#`` without that character; distinct, sorted."""
    marked = F.filter(split_words(col), lambda w: w.startswith("#"))
    return F.array_sort(F.array_distinct(F.transform(marked, strip_first)))


_REGEX_SIGNS = re.compile(r"[\\^$.|?*+()\[\]{}]")


def is_pattern(keyword: str) -> bool:
    """Whether a keyword is a regular expression that is more than its own text."""
    return bool(_REGEX_SIGNS.search(keyword))


def contains_keyword(col: Column | str, keyword: str, literal: bool = False) -> Column:
    """Case-sensitive search for ``keyword`` anywhere in the text.

    The keyword is a regular expression unless ``literal``. One without special
    signs is searched as a plain substring, which gives the same and is faster.
    """
    text = F.col(col) if isinstance(col, str) else col
    if literal or not is_pattern(keyword):
        return text.contains(F.lit(keyword))
    return text.rlike(keyword)


def sql_text(value: str) -> str:
    """A string as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def keyword_sql(col: str, keyword: str) -> str:
    """``contains_keyword`` as SQL text.

    Expressions over many keywords are built as one text: composing them column by
    column costs seconds before a job even starts.
    """
    if is_pattern(keyword):
        return f"`{col}` RLIKE {sql_text(keyword)}"
    return f"contains(`{col}`, {sql_text(keyword)})"


# From this length on a keyword seldom stands in a text, so a search for it runs to the text's end.
_LONG = 4
_TOGETHER = 24  # long keywords for which one pass for all is faster than a search for each


def long_keywords(keywords: Sequence[str]) -> list[str]:
    """The keywords that ``held_keywords`` looks for; none where searching each by itself is faster."""
    found = [k for k in dict.fromkeys(keywords) if len(k) >= _LONG and not is_pattern(k)]
    return found if len(found) >= _TOGETHER else []


def _one_of(signs) -> str:
    return "[" + "".join(re.escape(c) for c in sorted(set(signs))) + "]"


def _longest_of(words: Sequence[str]) -> str:
    """Pattern of the longest of the words that stands at a place: a tree over their characters."""
    rest: dict[str, list[str]] = {}
    for word in words:
        if word:
            rest.setdefault(word[0], []).append(word[1:])
    if not rest:
        return ""
    either = "|".join(re.escape(c) + _longest_of(tails) for c, tails in sorted(rest.items()))
    return f"(?:{either})" + ("?" if "" in words else "")


def held_keywords(col: Column | str, keywords: Sequence[str]) -> Column:
    """A short text that contains those of the ``long_keywords`` that ``col`` contains, and no others.

    It is found in one pass, whatever their number: the longest keyword that begins at each place.
    Any other one that begins there is the beginning of it. A sign that no keyword holds stands
    between them.
    """
    # Most places are told by four signs.
    guard = "".join(_one_of(k[i] for k in keywords) for i in range(_LONG))
    sign = next(c for c in map(chr, range(1, sys.maxunicode)) if not any(c in k for k in keywords))
    found = F.regexp_extract_all(col, F.lit(f"(?={guard})(?=({_longest_of(keywords)}))"), F.lit(1))
    return F.array_join(F.array_distinct(found), sign)


def any_keyword(col: Column | str, keywords: Sequence[str], first: int | None = None) -> Column:
    """True where the text holds at least one of the (first) keywords."""
    tests = [contains_keyword(col, k) for k in list(keywords)[:first]]
    return reduce(lambda a, b: a | b, tests, F.lit(False))
