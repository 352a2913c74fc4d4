"""SimHash and its joins against plain brute force."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from newsloom.functions.hashing import hamming, simhash
from newsloom.operators.dedup import dedup_simhash, dedup_url, simhash_pairs
from newsloom.operators.near_hash import key_masks, near_pairs

M = 2**64 - 1


def signed(h):
    return h - 2**64 if h >> 63 else h


def plain_simhash(text):
    words = re.sub(r"[^\w]+", "", text.lower())
    grams = [words[i : i + 4] for i in range(max(len(words) - 3, 1))]
    hashes = [int(hashlib.md5(g.encode()).hexdigest()[16:], 16) for g in grams]
    return signed(sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)))


def test_simhash_equals_plain_python(spark):
    texts = ["The quick brown fox", "", "ab", "ÄÖÜ straße 東京都", "x" * 70_000 + "quick brown", "a b c d " * 50]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["h"] for r in df.select("i", simhash(F.col("t")).alias("h")).orderBy("i").collect()]
    assert got == [plain_simhash(t) for t in texts]


def test_similar_texts_are_near(spark):
    base = "Global leaders met in Geneva on Tuesday to discuss climate policy and trade. " * 5
    df = spark.createDataFrame([(base, base.replace("Tuesday", "Wednesday", 1), "Local team wins the cup")], "a string, b string, c string")
    row = df.select(
        hamming(simhash(F.col("a")), simhash(F.col("b"))).alias("near"),
        hamming(simhash(F.col("a")), simhash(F.col("c"))).alias("far"),
    ).first()
    assert row["near"] < 10 < row["far"]


@pytest.mark.parametrize("a, b, expected", [(0, 0, 0), (15, 0, 4), (10, 5, 4), (-1, 0, 64), (-(2**63), 0, 1)])
def test_hamming(spark, a, b, expected):
    df = spark.createDataFrame([(a, b)], "a bigint, b bigint")
    assert df.select(hamming(F.col("a"), F.col("b")).alias("d")).first()["d"] == expected


def random_hashes(n, seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(6)]
    out = []
    for _ in range(n):
        h = rng.choice(centres)
        for _ in range(rng.randrange(7)):
            h ^= 1 << rng.randrange(64)
        out.append(h)
    out[n // 3 : 2 * n // 3] = [centres[0]] * (n // 3)  # a third of all rows are copies
    return out


def frame(spark, hashes, prefix="a"):
    rows = [(f"{prefix}{i:04d}", i, signed(h)) for i, h in enumerate(hashes)]
    return spark.createDataFrame(rows, "id string, ord bigint, simhash bigint").repartition(4)


def greedy(hashes, stored, t):
    seen, kept = list(stored), []
    for i, h in enumerate(hashes):
        if all(((h ^ s) & M).bit_count() > t for s in seen):
            seen.append(h)
            kept.append(f"a{i:04d}")
    return kept


@pytest.mark.parametrize("t", [0, 3, 8])
@pytest.mark.parametrize("finish", [0, 10, 20_000])
def test_rounds_equal_the_sequential_pass(spark, t, finish):
    hashes, stored = random_hashes(150, t + 1), random_hashes(12, 99)
    got = dedup_simhash(frame(spark, hashes), frame(spark, stored, "s"), t, finish)
    assert sorted(r["id"] for r in got.collect()) == greedy(hashes, stored, t)


def test_a_chain_keeps_its_ends(spark):
    a, b, c = 0, 0b111, 0b111111
    for finish in (0, 100):
        got = dedup_simhash(frame(spark, [a, b, c]), None, 3, finish).collect()
        assert sorted(r["id"] for r in got) == ["a0000", "a0002"]


def test_empty_batch(spark):
    assert dedup_simhash(frame(spark, [1]).limit(0)).count() == 0


@pytest.mark.parametrize("chunk_rows", [5, 20_000])
def test_near_pairs_with_crowded_buckets(spark, chunk_rows):
    left, right = sorted(set(random_hashes(80, 5))), sorted(set(random_hashes(60, 5)) | set(random_hashes(20, 6)))
    lf = spark.createDataFrame([(signed(h),) for h in left], "lh bigint")
    rf = spark.createDataFrame([(signed(h),) for h in right], "rh bigint")
    got = {tuple(r) for r in near_pairs(lf, rf, 3, 80, chunk_rows=chunk_rows).distinct().collect()}
    assert got == {(signed(x), signed(y)) for x in left for y in right if (x ^ y).bit_count() <= 3}


def test_first_earlier_near_article(spark):
    hashes = random_hashes(90, 8)
    got = {r["id"]: (r["match_id"], r["distance"]) for r in simhash_pairs(frame(spark, hashes)).collect()}
    expected = {}
    for i, h in enumerate(hashes):
        for j in range(i):
            if (h ^ hashes[j]).bit_count() <= 3:
                expected[f"a{i:04d}"] = (f"a{j:04d}", (h ^ hashes[j]).bit_count())
                break
    assert got == expected


def test_keys_cover_every_way_to_differ():
    for t, m in ((3, 1), (3, 2), (3, 3), (0, 1), (8, 2)):
        masks = [k & M for k in key_masks(t, m)]
        for _ in range(200):
            flips = sum({1 << random.randrange(64) for _ in range(t)})
            assert any(flips & k == 0 for k in masks)


def test_dedup_url(spark):
    columns = "id string, ord bigint, source_url string"
    old = spark.createDataFrame([("o", 0, "u0")], columns)
    new = spark.createDataFrame([("a", 2, "u1"), ("b", 1, "u1"), ("c", 3, "u0"), ("d", 4, "u2")], columns)
    assert sorted(r["id"] for r in dedup_url(new, old).collect()) == ["b", "d"]


def test_near_pairs_are_not_sorted(spark):
    """The first match is kept in a hash table: pairs of a task are never sorted, however many there are; ties go to the smaller hash."""
    rows = [("b", 2, 0), ("a", 1, 7), ("a", 1, 3), ("c", 3, 1 << 40), ("d", 4, 0)]
    df = spark.createDataFrame(rows, "id string, ord long, simhash long")
    got = simhash_pairs(df)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "min(match" not in plan and "min(place" in plan
    assert sorted(map(tuple, got.collect())) == [("b", "a", 2), ("c", "a", 3), ("d", "a", 2)]
