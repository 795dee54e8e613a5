"""Tone features of a text: sentiment, capitals, punctuation and length."""

from pyspark.sql import DataFrame, functions as F

from .sentiment import with_sentiment
from .text import caps_ratio, count_char

TONE = ("compound", "neg", "pos", "caps_ratio", "exclamations", "questions", "log_length")


def with_tone(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the seven tone features; exclamation and question marks count up to five."""
    t = F.col(text)
    return with_sentiment(df, text).drop("neu").withColumns(
        {
            "caps_ratio": caps_ratio(t),
            "exclamations": F.least(count_char(t, "!"), F.lit(5)),
            "questions": F.least(count_char(t, "?"), F.lit(5)),
            "log_length": F.log1p(F.length(t)),
        }
    )
