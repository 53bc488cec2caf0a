"""Tokens, previews, hashes and rounding as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, numbers and underscore of any script.
WORD_PATTERN = r"[\p{L}\p{N}_]+"
HANGUL_PATTERN = r"[\x{AC00}-\x{D7A3}]+"


def fold(text: Column) -> Column:
    """Lower case with sharp s written out, so that tokens match however they are cased."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def words(text: Column) -> Column:
    """Word tokens in order, repeats included; null text gives null."""
    return F.regexp_extract_all(fold(text), F.lit(f"({WORD_PATTERN})"), 1)


def _grams(run: Column, n: int) -> Column:
    many = F.length(run) >= n
    return F.when(many, F.transform(F.sequence(F.lit(1), F.length(run) - n + 1), lambda i: F.substring(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def words_and_hangul_grams(text: Column) -> Column:
    """Each word, followed by the two- and then three-character grams of its Hangul runs, the word itself left out."""

    def expanded(token: Column) -> Column:
        runs = F.regexp_extract_all(token, F.lit(f"({HANGUL_PATTERN})"), 1)
        grams = F.flatten(F.transform(runs, lambda r: F.concat(_grams(r, 2), _grams(r, 3))))
        return F.concat(F.array(token), F.filter(grams, lambda g: g != token))

    return F.flatten(F.transform(words(text), expanded))


#: Tokenizers by name; a tokenizer is a function from a text column to an array of terms.
TOKENIZERS: dict[str, Callable[[Column], Column]] = {
    "unicode_words": words,
    "hangul_ngrams": words_and_hangul_grams,
}


def tokenizer(name: str) -> Callable[[Column], Column]:
    """The tokenizer of that name, or an error that lists the known ones."""
    if name not in TOKENIZERS:
        raise ValueError(f"unknown tokenizer {name!r}; known: {', '.join(sorted(TOKENIZERS))}")
    return TOKENIZERS[name]


def token_count(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"((?U)\S+)"), 1)).cast("long")


def squeezed(text: Column) -> Column:
    """White space at both ends dropped and inside made one space."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def preview(text: Column, limit: int, cut: int, tail: str = "...") -> Column:
    """Squeezed text; if longer than ``limit`` its first ``cut`` characters and ``tail``."""
    flat = squeezed(text)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, cut)), F.lit(tail)))


def search_preview(text: Column) -> Column:
    return preview(text, 240, 239)


def coverage_preview(text: Column) -> Column:
    return preview(text, 240, 237)


def context_preview(text: Column) -> Column:
    return preview(text, 220, 219)


def content_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 text in hexadecimal."""
    return F.sha2(text.cast("binary"), 256)


def half_even(value: Column, digits: int) -> Column:
    """Rounded with ties to the even neighbour."""
    return F.bround(value, digits)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole with ties to even, 0 where there is nothing."""
    share = F.try_divide(part.cast("decimal(20,0)") * 100, whole.cast("decimal(20,0)"))
    return F.when(whole > 0, F.bround(share, digits).cast("double")).otherwise(F.lit(0.0))
