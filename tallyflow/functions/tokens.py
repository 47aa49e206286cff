"""Tokens and cumulative 1..n-grams as column expressions.

A body is cut at each space and newline; empty tokens stay, and the body's last character is never part of a token (so the last
token of a body without a trailing separator loses its end). An n-gram is the raw slice from its first to its last token, inner
separators included. An empty body has no tokens. Works by characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def elements(body: Column) -> Column:
    """Tokens with the separator that ends each, as an array."""
    inner = F.concat(F.substring(body, F.lit(1), F.char_length(body) - 1), F.lit(" "))
    return F.when(F.coalesce(F.char_length(body), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.regexp_extract_all(inner, F.lit("[^ \n]*[ \n]"), F.lit(0)))


def _without_end(s: Column) -> Column:
    return F.substring(s, F.lit(1), F.char_length(s) - 1)


def tokens(body: Column) -> Column:
    return F.transform(elements(body), _without_end)


def word(body: Column, i: int) -> Column:
    """Token i, from 0; null beyond the end."""
    return F.get(tokens(body), F.lit(i))


def num_words(body: Column) -> Column:
    """One more than the separators before the last character; 0 for an empty or null body."""
    inner = _without_end(body)
    seps = F.char_length(inner) - F.char_length(F.translate(inner, " \n", ""))
    return F.when(F.coalesce(F.char_length(body), F.lit(0)) == 0, F.lit(0)).otherwise(seps + 1).cast("long")


def ngram(els: Column, i: Column, k: Column) -> Column:
    """The k-gram that begins at token i, from 1."""
    return _without_end(F.array_join(F.slice(els, i, k), ""))


def ngram_total(words: Column, n: int) -> Column:
    """How many 1..n-grams a body of so many tokens has: those of n = min(n, words) and shorter."""
    m = F.least(F.lit(n), words).cast("long")
    return m * words - F.floor(m * (m - 1) / 2).cast("long")


def ngrams(emails: DataFrame, n: int, body_col: str = "body", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep..., k, ng: a row for each occurrence of each 1..n-gram."""
    rows = emails.select(*keep, elements(F.col(body_col)).alias("els")).where(F.size("els") > 0)
    sizes = rows.select(*keep, "els", F.explode(F.sequence(F.lit(1), F.least(F.lit(n), F.size("els")))).alias("k"))
    starts = sizes.select(*keep, "els", "k", F.explode(F.sequence(F.lit(1), F.size("els") - F.col("k") + 1)).alias("i"))
    return starts.select(*keep, "k", ngram(F.col("els"), F.col("i"), F.col("k")).alias("ng"))
