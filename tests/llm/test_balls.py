"""Ball hashing against fingerprints and links spelled out one by one."""

from __future__ import annotations

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from newsloom.llm import balls, longtext
from tests.llm.test_operators import docs, none, odd, texts  # noqa: F401


def plain_fingerprint(text, shingle=3) -> int:
    words = (text or "").encode().lower().split()
    groups = [words[i : i + shingle] for i in range(len(words) - shingle + 1)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in groups]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(found: list, radius=2) -> dict:
    """Least id reachable for each row of (id, fingerprint)."""
    top = list(range(len(found)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, (_, x) in enumerate(found):
        for j in range(i):
            if (x ^ found[j][1]).bit_count() <= radius:
                top[find(i)] = find(j)
    least: dict = {}
    for i, (name, _) in enumerate(found):
        if name is not None:
            least[find(i)] = min(least.get(find(i), name), name)
    return {i: least.get(find(i)) for i in range(len(found))}


def test_ball_hashing(docs, texts):  # noqa: F811
    ids = sorted(texts)
    found = [(i, plain_fingerprint(texts[i])) for i in ids]
    want = plain_components(found)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in balls.near_fingerprints(docs).collect()}
    assert got == {i: (f"{fp:016x}", want[n]) for n, (i, fp) in enumerate(found)}


def test_ball_hashing_of_odd_rows(odd, none):  # noqa: F811
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    want = plain_components([(i, plain_fingerprint(t)) for i, t in rows])
    expected = sorted(((i, f"{plain_fingerprint(t):016x}", want[n]) for n, (i, t) in enumerate(rows)), key=repr)
    assert sorted((tuple(r) for r in balls.near_fingerprints(odd).collect()), key=repr) == expected
    assert balls.near_fingerprints(none).count() == 0


@pytest.mark.parametrize("radius", [2, 4])
def test_links_lose_none(spark, radius):
    rng = random.Random(radius)
    found = set()
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(12):  # walks, so that chains and crowds around a point both occur
            found.add(at)
            for _ in range(rng.randrange(1, radius + 3)):
                at ^= 1 << rng.randrange(64)
    found = sorted(found)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(x),) for x in found], "fp long")
    pairs = [(r.a, r.b) for r in balls.links(nodes, radius).collect()]
    assert len(pairs) == len(set(pairs)) and all((a ^ b & (1 << 64) - 1).bit_count() for a, b in pairs)
    top = {signed(x): signed(x) for x in found}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in pairs:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= radius
        top[max(find(a), find(b))] = min(find(a), find(b))
    want = plain_components([(signed(x), x) for x in found], radius)
    for i, x in enumerate(found):
        for j, y in enumerate(found):
            assert (find(signed(x)) == find(signed(y))) == (want[i] == want[j])


def test_a_ball_around_a_point_is_one_component(spark):
    """All 64 neighbours of a point are within two bits of each other, and no key holds more than a ball."""
    point = 0x0123456789ABCDEF
    nodes = spark.createDataFrame([((point ^ 1 << b) - (1 << 64 if (point ^ 1 << b) >> 63 else 0),) for b in range(64)], "fp long")
    assert balls.links(nodes).select(F.col("b")).distinct().count() == 63
    with pytest.raises(ValueError):
        balls.links(nodes, 3)


def test_long_texts_in_parts(monkeypatch):
    rng = random.Random(3)
    found = [" ".join(f"W{rng.randrange(50)}" for _ in range(n)) for n in (0, 1, 2, 3, 7, 100, 1001)]
    want = balls.simhashes([t.encode() for t in found])
    assert [int(x) & (1 << 64) - 1 for x in want] == [plain_fingerprint(t) for t in found]
    for most in (3, 10):
        monkeypatch.setattr(balls, "word_chunks", lambda text, keep, most=most: longtext.word_chunks(text, keep, most))
        assert (balls.simhashes([t.encode() for t in found]) == want).all()


def test_word_chunks():
    for text in (b"", b"  ", b"a", b" a b\tc\n", b"a b c d e f g "):
        for keep in (0, 1, 2):
            parts = list(longtext.word_chunks(text, keep, 3))
            words = parts[0] + [w for p in parts[1:] for w in p[keep:]]
            assert words == text.split() and all(len(p) <= 3 + keep for p in parts)
