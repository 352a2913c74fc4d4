"""Importance resampling against plain counting."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest

from newsloom.llm import longtext, resampling
from tests.llm.test_operators import none, odd  # noqa: F401

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_features(text, longest) -> tuple[list, int]:
    words = WORD.findall((text or "").translate(LOWER))
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)], len(words)


def plain(rows: list, target: list, longest=1, least=20, percent=10) -> list:
    """(doc_id, n_features, weight, score, rank) in the order of the rows."""
    hashed = lambda texts: Counter(crc32(f.encode()) % 10_000 for t in texts for f in plain_features(t, longest)[0])
    raw, wanted = hashed([t for _, t in rows]), hashed(target)
    s_all, t_all = raw.total() + 10_000, wanted.total() + 10_000
    out = []
    for doc_id, text in rows:
        found, n_words = plain_features(text, longest)
        weight = sum(math.floor(1000 * math.log((wanted[b] + 1) * s_all / ((raw[b] + 1) * t_all))) for b in (crc32(f.encode()) % 10_000 for f in found))
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words))
    order = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0], -r[1]))
    n = percent * len(order) // 100
    ranks: dict = {}
    for rank, r in enumerate(order, 1):
        ranks.setdefault(r, []).append(rank if rank <= n else None)
    return [(*r[:4], ranks[r].pop(0) if r[4] >= least else None) for r in out]


def made(spark, seed: int, n=400):
    rng = random.Random(seed)
    text = lambda: " ".join(rng.choice("alpha Beta gamma Été 7 x9 don't foo_bar delta".split()) + str(rng.randrange(40)) for _ in range(rng.randrange(60)))
    rows = [(i, text()) for i in range(n)]
    target = [text() for _ in range(15)] + [None, ""]
    return rows, target, spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame([(t,) for t in target], "text string")


@pytest.mark.parametrize("longest, least, percent", [(1, 20, 10), (3, 5, 50), (2, 0, 100), (1, 10**6, 10)])
def test_ranked(spark, longest, least, percent):
    rows, target, docs, wanted = made(spark, longest)
    found = [tuple(r) for r in resampling.ranked(docs, wanted, longest, least, percent).collect()]
    assert sorted(found, key=repr) == sorted(plain(rows, target, longest, least, percent), key=repr)


def test_reruns_and_splits_agree(spark):
    _, _, docs, wanted = made(spark, 9)
    first = sorted(resampling.ranked(docs, wanted, least=5).collect(), key=repr)
    assert sorted(resampling.ranked(docs.repartition(2), wanted, least=5).collect(), key=repr) == first


def test_drawn_keeps_all_columns(spark):
    from pyspark.sql import functions as F

    _, _, docs, wanted = made(spark, 5)
    wide = docs.withColumns({"weight": F.lit("w"), "row": F.lit(1), "part": F.lit(2)})
    took = resampling.drawn(wide, wanted, least=10, percent=20)
    assert took.columns == wide.columns
    want = {r.doc_id for r in resampling.ranked(docs, wanted, least=10, percent=20).collect() if r.rank is not None}
    assert sorted(r.doc_id for r in took.collect()) == sorted(want) and want
    assert resampling.drawn(wide, wanted, least=10, percent=0).count() == 0


def test_odd_rows(spark, odd, none):  # noqa: F811
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    target = spark.createDataFrame([("word1 word2 tail", 1), (None, 2)], "text string, doc_id int")
    for wanted, texts in ((target, ["word1 word2 tail", None]), (target.limit(0), [])):
        found = [tuple(r) for r in resampling.ranked(odd, wanted, least=1, percent=60).collect()]
        assert sorted(found, key=repr) == sorted(plain(rows, texts, 1, 1, 60), key=repr)
    assert resampling.ranked(none, target).count() == 0 and resampling.drawn(none, target).count() == 0


def test_a_crowd_of_equal_rows_is_numbered_in_parts(spark):
    from pyspark.sql import functions as F

    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.range(0, 2000, 1, 8).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    ranks = sorted(r.rank for r in resampling.ranked(docs, docs.limit(1), percent=50).collect() if r.rank is not None)
    assert ranks == list(range(1, 1001))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = resampling.in_order(resampling.scores(docs, docs.limit(1))).groupBy("part").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(placed) > 1


def test_long_texts_in_parts(monkeypatch):
    rng = random.Random(2)
    text = " ".join(rng.choice("abcdef") for _ in range(500)).encode()
    for longest in (1, 2, 3):
        want = resampling.features(text, longest)
        assert want[1] == sum(500 - n + 1 for n in range(1, longest + 1)) and want[2] == 500
        monkeypatch.setattr(resampling, "word_chunks", lambda text, keep: longtext.word_chunks(text, keep, 7))
        assert resampling.features(text, longest) == want
        monkeypatch.undo()
