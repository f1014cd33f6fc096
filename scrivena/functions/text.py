"""Column expressions over texts: cleaning, lengths, redaction, shares of characters and words."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters whose shares are features, and common function words.
LETTERS = list("abcdefghijklmnopqrstuvwxyzæøå")
FUNCTION_WORDS = "og i det på som er en til å av for med at de ikke den har et om vi the of and la le der die und que el".split()
ZERO_WIDTH = "[\u200b\u200c\u200d\u2060\ufeff\u00ad]"
NARROW = "[\u00a0\u202f]"


def canonical_id(value: Column) -> Column:
    """Integer-valued text as an integer's text ("12.0" -> "12"), other text trimmed, null as empty."""
    text = F.trim(value.cast("string"))
    number = text.try_cast("double")
    whole = number.isNotNull() & (number == F.floor(number)) & (F.abs(number) < 1e18)
    return F.when(text.isNull(), "").when(whole, F.floor(number).cast("string")).otherwise(text)


def flag(value: Column) -> Column:
    """Whether a value reads as yes: true, 1 or yes in any case; null and anything else is no."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def label(value: Column, aliases: dict[str, str] | None = None) -> Column:
    """A label's text as ``canonical_id`` has it, by its other name if ``aliases`` has one."""
    text = canonical_id(value)
    out = text
    for old, new in (aliases or {}).items():
        out = F.when(text == old, new).otherwise(out)
    return out


def normalised_text(text: Column) -> Column:
    """Without zero-width characters, soft hyphens and runs of three or more double quotes; white space as single spaces."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), ZERO_WIDTH, "")
    out = F.regexp_replace(F.regexp_replace(out, NARROW, " "), '"{3,}', "")
    return F.trim(F.regexp_replace(out, r"[\s\x0B]+", " "))


def spaced_punctuation(text: Column) -> Column:
    """A space after . ! ? before an upper-case letter, after , ; before a letter, and after : before a letter."""
    out = F.regexp_replace(text, r"(?<=[\p{L}\p{N}][.!?])(?=\p{Lu})", " ")
    out = F.regexp_replace(out, r"(?<=[,;])(?=\p{L})", " ")
    return F.regexp_replace(out, r"(?<=:)(?=\p{L})", " ")


def redaction_pattern(values: list[str]) -> str:
    """One pattern for all values, longest first; the first letter in the case given, the rest in any; whole words only."""
    different = sorted({v.strip() for v in values if v and len(v.strip()) >= 2}, key=lambda v: (-len(v), v))
    parts = [re.escape(v[0]) + "(?iu:" + re.sub(r"\\?\s+", r"\\s+", re.escape(v[1:])) + ")" for v in different]
    return r"(?U)(?<![\w>])(?:" + "|".join(parts) + r")(?:['’]?s)?(?![\w<])"


def fragment(value: Column) -> Column:
    """The part of ``redaction_pattern`` for one value."""
    escape = lambda c: F.regexp_replace(c, r"([^\p{L}\p{N}\s])", r"\\$1")
    rest = F.regexp_replace(escape(F.substr(value, F.lit(2))), r"\s+", r"\\s+")
    return F.concat(escape(F.substring(value, 1, 1)), F.lit("(?iu:"), rest, F.lit(")"))


def whole_words(fragments: Column) -> Column:
    """The pattern of an array of fragments: whole words, with or without a possessive ending."""
    return F.concat(F.lit(r"(?U)(?<![\w>])(?:"), F.array_join(fragments, "|"), F.lit(r")(?:['’]?s)?(?![\w<])"))


def folded_words(text: Column) -> Column:
    """Different words without regard to case, for a search by words: what (?iu) takes as equal is equal here."""
    plain = F.replace(F.lower(F.upper(F.lower(text))), F.lit("\u0307"), F.lit(""))
    return F.array_distinct(F.regexp_extract_all(plain, F.lit(r"((?U)\w+)"), F.lit(1)))


def redacted(text: Column, values: list[str], replacement: str) -> Column:
    """Struct of the redacted text and the number of replacements; without values nothing is replaced."""
    if not values:
        return F.struct(text.alias("text"), F.lit(0).alias("n"))
    pattern = redaction_pattern(values)
    return F.struct(F.regexp_replace(text, F.lit(pattern), F.lit(replacement)).alias("text"), F.regexp_count(text, F.lit(pattern)).alias("n"))


def word_count(text: Column) -> Column:
    """Runs of characters that aren't white space; null as none."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\s\x0B]+"), lambda w: w != "")).cast("long")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null as none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def share_of_letter(text: Column, letter: str) -> Column:
    low = F.lower(text)
    return F.coalesce(F.try_divide((F.length(low) - F.length(F.replace(low, F.lit(letter), F.lit("")))).cast("double"), F.length(text).cast("double")), F.lit(0.0))


def age_bin(age: Column, edges: list[int]) -> Column:
    """"a-b" for a <= age < b of neighbouring edges, else "unknown"."""
    out = F
    for low, high in zip(edges, edges[1:]):
        out = out.when((age >= low) & (age < high), f"{low}-{high - 1}")
    return out.otherwise("unknown")


def party_axis(party: Column, axes: dict[str, list[str]]) -> Column:
    """The axis that lists the party, compared in lower case without spaces and hyphens; else "unknown"."""
    plain = lambda s: re.sub("[ -]", "", s.strip().lower())
    pairs = [F.lit(x) for axis, parties in axes.items() for p in parties for x in (plain(p), axis)]
    key = F.regexp_replace(F.lower(F.trim(party)), "[ -]", "")
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce(key, F.lit(""))), F.lit("unknown"))


def head_and_tail(items: Column, head: int, tail: int) -> Column:
    """The first ``head`` and last ``tail`` of a longer array; a shorter one whole."""
    return F.when(F.size(items) > head + tail, F.concat(F.slice(items, 1, head), F.slice(items, -tail, tail))).otherwise(items)
