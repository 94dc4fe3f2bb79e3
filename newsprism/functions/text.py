"""Headline sentiment (U1) as a native column expression (no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed word lists of the keyword sentiment score.
POSITIVE_WORDS = ("good", "great", "amazing", "excellent", "success", "win", "best")
NEGATIVE_WORDS = ("bad", "terrible", "worst", "fail", "crisis", "disaster", "problem")


def _hits(text: Column, words: tuple[str, ...]) -> Column:
    total = F.lit(0)
    for w in words:
        total = total + F.when(F.contains(text, F.lit(w)), 1).otherwise(0)
    return total


def token_count(text: Column) -> Column:
    """Number of whitespace-separated tokens (runs of any Unicode whitespace split)."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda t: t != ""))


def headline_sentiment(headline: Column) -> Column:
    """(positive words contained − negative words contained) / max(token count, 1).

    Words are matched as substrings of the lower-cased headline, each word counted once;
    NULL or empty headlines score 0.0.
    """
    low = F.lower(headline)
    score = (_hits(low, POSITIVE_WORDS) - _hits(low, NEGATIVE_WORDS)).cast("double") / F.greatest(
        token_count(low), F.lit(1)
    ).cast("double")
    return F.when(headline.isNull() | (headline == ""), F.lit(0.0)).otherwise(score)
