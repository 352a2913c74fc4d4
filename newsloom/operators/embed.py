"""Embeddings of articles and queries: a model function, or a default that needs no model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import IDF, IDFModel, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.text import WORD, article_text

EmbedFn = Callable[[pd.Series], pd.Series]
#: Texts whose words are numbered and counted at once.
SLICE_TEXTS = 2048


def buckets(words: set[str], dim: int) -> dict[str, int]:
    """A word's dimension: the first 32 bits of its MD5, the same in every engine."""
    return {w: int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big") % dim for w in words}


def _counts(texts: pa.Array, dim: int, of: dict[str, int]) -> np.ndarray:
    """How often the words of each text fall on each dimension, one text after the other; a null text has none.
    ``of`` remembers the dimensions of words."""
    lengths = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False)
    words = pc.list_flatten(texts).dictionary_encode()
    names = words.dictionary.to_pylist()
    of |= buckets({w for w in names if w not in of}, dim)
    place = np.array([of[w] for w in names], np.int64)[words.indices.to_numpy()] if names else np.empty(0, np.int64)
    place += np.repeat(np.arange(len(texts)) * dim, lengths)
    return np.bincount(place, minlength=len(texts) * dim).astype(np.float64)


def _counted(df: DataFrame, text: str, dim: int) -> DataFrame:
    words = F.filter(F.split(F.lower(text), f"[^{WORD[1:-1]}]+"), lambda w: w != "")

    def count(texts: pa.Array) -> pa.Array:
        # each distinct word of a batch is hashed once
        flat, of = np.empty(len(texts) * dim), {}
        for i in range(0, len(texts), SLICE_TEXTS):
            some = texts.slice(i, SLICE_TEXTS)
            flat[i * dim : (i + len(some)) * dim] = _counts(some, dim, of)
        return pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, dim, dtype=np.int32), flat)

    return df.withColumn("_tf", array_to_vector(F.arrow_udf(count, T.ArrayType(T.DoubleType()))(words)))


def fit_idf(df: DataFrame, text: str, dim: int = 768) -> IDFModel:
    """Word weights from a corpus; one vector of ``dim`` numbers reaches the driver."""
    return IDF(inputCol="_tf", outputCol="_weighted").fit(_counted(df, text, dim))


def embed_text(
    df: DataFrame, text: str, fn: EmbedFn | None = None, dim: int = 768, idf: IDFModel | None = None
) -> DataFrame:
    """``df`` with an ``embedding`` of its ``text`` column.

    ``fn`` maps a batch of texts to a batch of vectors and runs on Arrow batches.
    Without it, words are hashed to ``dim`` counts, weighted by ``idf`` if given, and
    scaled to unit length. The weights come from outside so that the same
    text gets the same vector in every batch.
    """
    if fn is not None:
        model = F.pandas_udf(fn, T.ArrayType(T.FloatType()))
        return df.withColumn("embedding", model(F.col(text)))
    counted = _counted(df, text, dim)
    source = "_tf"
    if idf is not None:
        counted, source = idf.transform(counted), "_weighted"
    scaled = Normalizer(inputCol=source, outputCol="_unit").transform(counted)
    return scaled.withColumn("embedding", vector_to_array("_unit", "float32")).select(*df.columns, "embedding")


def embed_articles(
    articles: DataFrame,
    fn: EmbedFn | None = None,
    dim: int = 768,
    max_chars: int = 1500,
    idf: IDFModel | None = None,
) -> DataFrame:
    """Articles with the embedding of title and summary, of which a model reads at most ``max_chars`` characters."""
    cut = articles.withColumn("_text", article_text(articles, max_chars if fn else None))
    return embed_text(cut, "_text", fn, dim, idf).drop("_text")
