"""Text predicates and rewrites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.strip removes: Unicode white space and the four separators of ASCII.
STRIP = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, STRIP, "")


def starts_lower(text: Column) -> Column:
    return text.rlike(r"^\p{javaLowerCase}")


def starts_upper(text: Column) -> Column:
    return text.rlike(r"^\p{javaUpperCase}")


def starts_digit(text: Column) -> Column:
    return text.rlike(r"^[\p{Nd}²³¹⁰⁴-⁹₀-₉]")


def semantic_dash(text: Column) -> Column:
    """A closing dash that is punctuation: an em dash, two hyphens, or a hyphen after a space."""
    return text.endswith("—") | text.endswith("--") | text.endswith(" -")


def joins_hyphen(before: Column, after: Column) -> Column:
    """A line that ends within a word which the next one goes on with."""
    return before.endswith("-") & ~semantic_dash(before) & starts_lower(after)


def html_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def repeats_itself(text: Column) -> Column:
    """Thirty characters or more whose first ten occur three times without overlap; any longer repeated prefix implies this."""
    occurrences = (F.length(text) - F.length(F.replace(text, F.substring(text, 1, 10), F.lit("")))) / 10
    return (F.length(text) >= 30) & (occurrences >= 3)


def without_repetition(text: Column) -> Column:
    """The shortest prefix of ten characters or more that the text goes on with once more; the text itself if there is none."""
    head = F.regexp_extract(text, r"(?s)^(.{10,}?)\1", 1)
    return stripped(F.when(head != "", head).otherwise(text))


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substr(text, F.lit(2))))


def like_original(original: Column, corrected: Column) -> Column:
    """The correction in the original's case: upper, title or lower; otherwise as the dictionary has it."""
    upper, lower = F.upper(original), F.lower(original)
    rest = F.substr(original, F.lit(2))
    title = F.left(original, F.lit(1)).rlike(r"^\p{Lu}") & (rest == F.lower(rest)) & (rest != F.upper(rest))
    return (
        F.when((original == upper) & (original != lower), F.upper(corrected))
        .when(title, capitalised(corrected))
        .when((original == lower) & (original != upper), F.lower(corrected))
        .otherwise(corrected)
    )
