"""Lexicon sentiment as native expressions.

Scores use the published normalisation: valences are summed and squashed by s / sqrt(s^2 + 15);
shares count each scored word with one extra point. The lexicon is this repository's own, so
absolute scores differ from those of other lexicons; pass another mapping to change it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Word valences
LEXICON: dict[str, float] = {
    "amazing": 2.8, "appreciate": 1.7, "best": 3.2, "excellent": 2.7, "fine": 0.8, "good": 1.9, "great": 3.1,
    "happy": 2.7, "helpful": 1.8, "kind": 2.4, "like": 1.5, "love": 3.2, "nice": 1.8, "perfect": 2.7, "please": 1.3,
    "thank": 1.5, "thanks": 1.9, "warm": 0.9, "welcome": 2.0, "wonderful": 2.7,
    "angry": -2.3, "annoyed": -1.6, "awful": -2.0, "bad": -2.5, "broken": -2.1, "damaged": -1.9, "disappointed": -1.9,
    "disgusting": -2.4, "fraud": -2.8, "frustrated": -2.0, "furious": -2.7, "hate": -2.7, "hell": -3.6, "horrible": -2.5,
    "late": -0.9, "lost": -1.3, "mess": -1.5, "missing": -1.2, "pathetic": -2.7, "poor": -2.1, "problem": -1.7,
    "ridiculous": -1.5, "sad": -2.1, "scam": -2.7, "terrible": -2.1, "unacceptable": -2.0, "unhappy": -1.8,
    "upset": -1.6, "useless": -1.8, "worried": -1.2, "worst": -3.1, "wrong": -2.1,
}
ALPHA = 15.0


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def valences(text: Column, lexicon: dict[str, float] = LEXICON) -> Column:
    """Valence of each word, 0 outside the lexicon."""
    table = F.create_map(*[F.lit(x) for pair in lexicon.items() for x in pair])
    return F.transform(tokens(text), lambda w: F.coalesce(F.try_element_at(table, w), F.lit(0.0)))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def squash(total: Column) -> Column:
    return F.round(total / F.sqrt(total * total + ALPHA), 4)


def compound(text: Column) -> Column:
    """Overall score in [-1, 1], 0 for a text without scored words."""
    return squash(_total(valences(text)))


def with_sentiment(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds neg, neu, pos (shares) and compound; words are looked up once per row."""
    v = F.col("__valences")
    pos = _total(F.transform(F.filter(v, lambda x: x > 0), lambda x: x + 1))
    neg = _total(F.transform(F.filter(v, lambda x: x < 0), lambda x: 1 - x))
    neu = F.size(F.filter(v, lambda x: x == 0)).cast("double")
    share = lambda x: F.round(F.coalesce(F.try_divide(x, F.col("__pos") + F.col("__neg") + F.col("__neu")), F.lit(0.0)), 3)
    return (
        df.withColumn("__valences", valences(F.col(text)))
        .withColumns({"__pos": pos, "__neg": neg, "__neu": neu, "compound": squash(_total(v))})
        .withColumns({"neg": share(F.col("__neg")), "neu": share(F.col("__neu")), "pos": share(F.col("__pos"))})
        .drop("__valences", "__pos", "__neg", "__neu")
    )


def sentiment_by_lexicon(df: DataFrame, key: str, lexicon: DataFrame, text: str = "text") -> DataFrame:
    """The same compound score with the lexicon as a table (token, valence), for large lexicons."""
    words = df.select(key, F.explode(tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))
    scored = words.join(lexicon, "token").groupBy(key).agg(F.sum(F.col("n") * F.col("valence")).alias("total"))
    return df.select(key).join(scored, key, "left").select(key, squash(F.coalesce("total", F.lit(0.0))).alias("compound"))
