"""Text to terms, as column expressions over whole texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from oddlog.functions.rows import bound

# Fixed value: runs of two or more word characters, the default word pattern.
DEFAULT_WORDS = r"[\p{L}\p{N}_]{2,}"


def java_pattern(pattern: str | None) -> str:
    """A Python-flavoured token pattern for the JVM, Unicode classes on."""
    if pattern is None or pattern in (r"(?u)\b\w\w+\b", r"\b\w\w+\b"):
        return DEFAULT_WORDS
    return "(?U)" + pattern.replace("(?u)", "")


def word_tokens(column: Column, pattern: str | None = None, lowercase: bool = True) -> Column:
    """All matches of the token pattern, in text order."""
    text = F.coalesce(column.cast("string"), F.lit(""))
    text = F.lower(text) if lowercase else text
    return F.regexp_extract_all(text, F.lit(java_pattern(pattern)), F.lit(0))


def _runs(length: Column, low: int, high: int, gram) -> Column:
    """``gram(start, n)`` for every run of ``low..high`` items, by n."""

    def of(n: int) -> Column:
        starts = F.when(length >= n, F.sequence(F.lit(1), length - (n - 1)))
        return F.coalesce(F.transform(starts, lambda i: gram(i, n)), F.array().cast("array<string>"))

    runs = [of(n) for n in range(low, high + 1)]
    return runs[0] if len(runs) == 1 else F.concat(*runs)


def word_ngrams(tokens: Column, low: int, high: int) -> Column:
    """Space-joined runs of ``low..high`` tokens."""
    if (low, high) == (1, 1):
        return tokens
    return bound(
        tokens,
        lambda ts: _runs(F.size(ts), low, high, lambda i, n: F.concat_ws(" ", F.slice(ts, i, F.lit(n)))),
    )


def char_ngrams(column: Column, low: int, high: int, lowercase: bool = True) -> Column:
    """Character runs of ``low..high``; repeated white space counts once."""
    text = F.coalesce(column.cast("string"), F.lit(""))
    text = F.lower(text) if lowercase else text
    text = F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]{2,}", " ")
    # Characters as an array: a run is a slice, not a scan from the start.
    return bound(
        F.split(text, ""),
        lambda cs: _runs(F.size(cs), low, high, lambda i, n: F.array_join(F.slice(cs, i, F.lit(n)), "")),
    )


def terms(
    column: Column,
    analyzer: str = "word",
    token_pattern: str | None = None,
    lowercase: bool = True,
    ngram_range: tuple[int, int] = (1, 1),
) -> Column:
    """Terms of a text under the vectoriser parameters."""
    low, high = ngram_range
    if analyzer == "char":
        return char_ngrams(column, low, high, lowercase)
    if analyzer != "word":
        raise ValueError(f"unknown analyzer {analyzer!r}")
    return word_ngrams(word_tokens(column, token_pattern, lowercase), low, high)
