"""Named entities of articles: a model function, a gazetteer, or capitalized names."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import WORD, article_text

# The entity labels.
LABELS = ["person", "organization", "location", "country", "political party", "event"]
MIN_SCORE = 0.4
# A gazetteer up to this many rows is copied to all executors, a larger one is shuffled.
MAX_SENT_TERMS = 200_000
NAME = r"\p{Lu}\p{L}+(?:[ ]\p{Lu}\p{L}+)+"

EntityFn = Callable[[pd.Series], pd.Series]


def distinct_entities(raw: DataFrame) -> DataFrame:
    """One row per article, lower-cased text and label: the spelling and place of the first.

    ``raw``: article_id, pos, text, label.
    """
    first = F.min(F.struct("pos", "text")).alias("first")
    by = ["article_id", "key", "label"]
    # a least struct is found by sorting; dealt out first, that sort shares no task with one that made ``raw``
    keyed = raw.select("article_id", "pos", "text", "label", F.lower("text").alias("key")).repartition(*by)
    grouped = keyed.groupBy(*by).agg(first)
    return grouped.select(
        F.sha2(F.concat_ws("|", "article_id", "key", "label"), 256).alias("id"),
        "article_id",
        F.col("first.text").alias("text"),
        "label",
        F.col("first.pos").alias("pos"),
    )


def gazetteer_mentions(texts: DataFrame, gazetteer: DataFrame, max_words: int = 1) -> DataFrame:
    """article_id, pos, text, label: the first place in each article of every term of the gazetteer
    ``(term, label)`` of up to ``max_words`` words, terms in lower case. ``texts``: article_id, text."""
    words = F.filter(F.split("text", f"[^{WORD[1:-1]}]+"), lambda w: w != "")
    listed = texts.select("article_id", words.alias("words"))

    def spans(n: int):
        if n == 1:
            return F.transform("words", lambda w, i: F.struct((i + 1).alias("pos"), w.alias("text")))
        last = F.greatest(F.size("words") - F.lit(n - 1), F.lit(0))
        starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(
            starts,
            lambda i: F.struct(i.alias("pos"), F.array_join(F.slice("words", i, F.lit(n)), " ").alias("text")),
        )

    runs = listed.select("article_id", F.inline(F.concat(*[spans(n) for n in range(1, max_words + 1)])))
    runs = runs.withColumn("term", F.lower("text"))
    place = F.min(F.struct("pos", "text")).alias("first")
    if gazetteer.limit(MAX_SENT_TERMS + 1).count() <= MAX_SENT_TERMS:
        found = runs.join(F.broadcast(gazetteer), "term").groupBy("article_id", "term", "label").agg(place)
    else:  # a frequent word counts once per article before anything moves
        found = runs.groupBy("article_id", "term").agg(place).join(gazetteer, "term").distinct()
    return found.select("article_id", "first.pos", "first.text", "label")


def extract_entities(
    articles: DataFrame,
    fn: EntityFn | None = None,
    gazetteer: DataFrame | None = None,
    max_chars: int = 2000,
    max_words: int = 1,
) -> DataFrame:
    """id, article_id, text, label, pos: distinct entities in title and content.

    A model reads at most ``max_chars`` characters; gazetteer and names read the whole text. ``fn`` maps a batch of texts to lists of ``{text, label, score}``; entities with
    a known label and a score of at least 0.4 count.
    """
    texts = articles.select(
        F.col("id").alias("article_id"), article_text(articles, max_chars if fn else None, body="content").alias("text")
    )
    if fn is not None:
        model = F.pandas_udf(fn, "array<struct<text:string,label:string,score:double>>")
        found = texts.select("article_id", F.posexplode(model("text")).alias("pos", "e")).where(
            F.col("e.label").isin(LABELS) & (F.col("e.score") >= MIN_SCORE)
        )
        raw = found.select("article_id", "pos", "e.text", "e.label")
    elif gazetteer is not None:
        raw = gazetteer_mentions(texts, gazetteer, max_words)
    else:
        names = F.regexp_extract_all("text", F.lit(NAME), F.lit(0))
        raw = texts.select("article_id", F.posexplode(names).alias("pos", "text")).withColumn(
            "label", F.lit("person")
        )
    return distinct_entities(raw)
