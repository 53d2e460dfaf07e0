"""Column functions on prose: paragraphs, sentences, words, syllables, grades.

All stay on the JVM and need no shuffle: a document is one row and its sentences an array. The
patterns use only what Java and RE2 read alike. A null text gives null, an empty one no parts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[ \t\n\r\f]"
WORD = r"[\p{L}\p{N}_]+"
TOKEN = r"[a-z']+"


def unix_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def _kept(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda x: F.btrim(x, F.lit(" \t\n\r\f"))), lambda x: x != "")


def sentences(c: Column) -> Column:
    """Array of sentences: split after . ! ? where blanks follow."""
    return _kept(F.split(c, r"(?<=[.!?])[ \t\n\r\f]+"))


def paragraphs(c: Column) -> Column:
    """Array of blocks between blank lines."""
    return _kept(F.split(unix_lines(c), r"\n[ \t\f]*\n"))


def prose_paragraphs(c: Column) -> Column:
    """Paragraphs that are no fenced code, heading, list or quote."""
    bare = F.regexp_replace(unix_lines(c), r"(?s)```.*?```", "\n\n")
    return F.filter(paragraphs(bare), lambda p: ~p.rlike(r"^(#{1,6} |[-*+] |\d+\. |>|\|)"))


def tokens(c: Column) -> Column:
    """Lower-case Latin words, apostrophes kept."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({TOKEN})"), 1)


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD))


def space_words(c: Column) -> Column:
    """Words as runs without blanks."""
    return F.regexp_count(c, F.lit(r"[^ \t\n\r\f]+"))


def first_word(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, rf"^[^\p{{L}}\p{{N}}_]*({WORD})", 1))


def syllables_by_groups(word: Column) -> Column:
    """Vowel groups, less a final e, at least 1."""
    w = F.lower(word)
    n = F.regexp_count(w, F.lit("[aeiouy]+"))
    return F.greatest(F.lit(1), n - F.when(w.rlike("e$") & (n > 1), 1).otherwise(0))


def syllables_by_pairs(word: Column) -> Column:
    """Vowels, less vowel pairs, plus i before a vowel, less a final e, at least 1."""
    w = F.lower(word)
    n = F.regexp_count(w, F.lit("[aeiouy]")) - F.regexp_count(w, F.lit("[aeiouy][aeiouy]")) + F.regexp_count(w, F.lit("i[aeou]"))
    return F.greatest(F.lit(1), n - F.when(w.rlike("e$"), 1).otherwise(0))


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("double"), lambda a, x: a + x)


def mean(array: Column) -> Column:
    return F.when(F.size(array) > 0, total(array) / F.size(array))


def variance(array: Column) -> Column:
    """Population variance."""
    m = mean(array)
    return F.when(F.size(array) > 0, F.greatest(F.lit(0.0), total(F.transform(array, lambda x: x.cast("double") * x)) / F.size(array) - m * m))


def reading_ease(c: Column, digits: int = 2) -> Column:
    """Flesch reading ease of a text, two decimals by default; null without words."""
    ws = tokens(c)
    n, s = F.size(ws), F.greatest(F.lit(1), F.size(sentences(c)))
    syl = total(F.transform(ws, syllables_by_groups))
    return F.when(n > 0, F.round(206.835 - 1.015 * n / s - 84.6 * syl / n, digits))


def grade(c: Column) -> Column:
    """Flesch-Kincaid grade of one sentence; null without words."""
    ws = tokens(c)
    n = F.size(ws)
    return F.when(n > 0, 0.39 * n + 11.8 * total(F.transform(ws, syllables_by_pairs)) / n - 15.59)


def jaccard(a: Column, b: Column) -> Column:
    """Share of common members of two arrays, 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def nearest_rank(sorted_array: Column, p: float) -> Column:
    """Percentile by nearest rank: index round(p * (n - 1)), halves to even, not interpolated."""
    i = F.bround(F.lit(p) * (F.size(sorted_array) - 1), 0).cast("int") + 1
    return F.try_element_at(sorted_array, i)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"(^-+|-+$)", "")


def canonical_name(*parts: Column) -> Column:
    """Parts joined by underscores in lower case, anything but letters and digits becoming one underscore."""
    return F.concat_ws("_", *[F.regexp_replace(F.regexp_replace(F.lower(p), r"[^a-z0-9]+", "_"), r"(^_+|_+$)", "") for p in parts])


def normal_path(c: Column) -> Column:
    """Slashes for backslashes, without leading ./ and doubled slashes."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(c), r"\\", "/"), r"/+", "/"), r"^(\./)+", "")


def symbol_mentions(c: Column) -> Column:
    """Distinct names in backticks and dotted names of a text."""
    ticked = F.regexp_extract_all(c, F.lit(r"`([A-Za-z_][A-Za-z0-9_.]*)(?:\(\))?`"), 1)
    dotted = F.regexp_extract_all(c, F.lit(r"([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+)"), 1)
    return F.array_distinct(F.concat(ticked, dotted))
