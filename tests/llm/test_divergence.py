"""The source audit against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from newsloom.llm import divergence
from newsloom.llm.longtext import word_chunks
from tests.compare import differences
from tests.llm.test_operators import none, odd  # noqa: F401

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
ROWS = "doc_id long, text string, lang string, source string, term string, n int"


def plain(rows: list, least=3, top=200) -> list:
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs, counts, groups = defaultdict(set), defaultdict(Counter), defaultdict(set)
    for row, (text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        for t in TERM.findall((text or "").translate(lower)):
            docs[lang, t].add(row)
            counts[lang, source][t] += 1
    out = []
    for lang, sources in groups.items():
        kept = [t for (x, t), d in docs.items() if x == lang and len(d) >= least]
        v = len(kept)
        total = Counter({t: sum(counts[lang, s][t] for s in sources) for t in kept})
        shares = lambda c, n: {t: 1 + 10**9 * (c[t] + 1) // (n + v) for t in kept}
        q = shares(total, sum(total.values()))
        p = {s: shares(counts[lang, s], sum(counts[lang, s][t] for t in kept)) for s in sources}
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


def got(df, **options) -> list:
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in divergence.divergences(df, **options).collect())


def made(seed: int) -> list:
    """Texts whose terms hang in many different chunks, some of them in a single document each."""
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "ÉTÉ", "été", "o'neil", "http", "x", "漢字", "a", "Z"] + [f"w{chr(97 + i)}" for i in range(12)]
    marks = ["", ",", ".", "(", "--", "://7", "9", "\x00", "'"]

    def chunk(row):
        word = rng.choice(vocabulary)
        extra = f"/{row}#{rng.choice(vocabulary)}" if rng.random() < 0.3 else rng.choice(marks)
        return rng.choice(marks) + word + extra

    out = []
    for row in range(60):
        text = rng.choice([" ", "\n", "\t "]).join(chunk(row) for _ in range(rng.randrange(12)))
        out.append((text if rng.random() < 0.95 else None, rng.choice(["en", "de", "", None, "xx"] if row else ["solo"]), rng.choice(["s1", "s2", "s3", "s1", "s1", None])))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_divergences(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame([(n % 7, *r, "clash", 1) for n, r in enumerate(rows)], ROWS).repartition(3)
    assert got(df) == plain(rows)
    assert got(df, least=2, top=3) == plain(rows, 2, 3)


@pytest.mark.parametrize("least, want", [(1, ["a", "b", "c", "http", "same", "twice"]), (2, ["http", "same", "twice"]), (3, ["http"])])
def test_rare_chunks_decide_exactly(spark, least, want):
    """'http' is in three documents but never in the same chunk; 'same' is in two, one of them twice; 'twice' in two, in many chunks."""
    many = lambda row: " ".join(f"twice:{row}{i}" for i in range(9))
    rows = [("http://a same:1 same:2 " + many(1), "en", "s"), ("http://b", "en", "s"), ("http://c same:3 " + many(2), "en", "t")]
    df = spark.createDataFrame([(None, *r, "", 0) for r in rows], ROWS).repartition(3)
    groups, seed = divergence.group_ids(df)
    chunks = divergence.chunk_counts(df, groups, seed)
    assert sorted({r.term for r in divergence.kept_terms(chunks, least).collect()}) == want
    with pytest.raises(ValueError):
        divergence.kept_terms(chunks, 4)


def test_chunks_are_counted_in_parts(spark, monkeypatch):
    rows = [*made(5), ("same other thing same more same", "en", "s1")]
    monkeypatch.setattr(divergence, "pieces", lambda batch: (batch.slice(i, 7) for i in range(0, batch.num_rows, 7)))
    monkeypatch.setattr(divergence, "WORDS", 20)
    monkeypatch.setattr(divergence, "word_chunks", lambda text: word_chunks(text, 0, 3))
    batches = [pa.RecordBatch.from_pydict({"text": [t for t, _, _ in rows], "gid": [len(s or "") for _, _, s in rows], "row": list(range(len(rows)))})]
    found = Counter()
    docs = Counter()
    named = defaultdict(set)
    for b in divergence.count_chunks(iter(batches)):
        for r in b.to_pylist():
            found[r["gid"], r["chunk"]] += r["n"]
            docs[r["gid"], r["chunk"]] += r["docs"]
            named[r["gid"], r["chunk"]] |= {x for x in (r["lo"], r["hi"]) if x is not None}
            assert (r["lo"] is None) == (r["docs"] > 2) and (r["hi"] is None) == (r["docs"] != 2)
    want, seen = Counter(), defaultdict(set)
    for row, (t, _, s) in enumerate(rows):
        for w in re.findall(r"[^\x20\x09-\x0D]+", t or ""):
            want[len(s or ""), w] += 1
            seen[len(s or ""), w].add(row)
    assert found == want and docs == {k: len(v) for k, v in seen.items()}
    assert all(named[k] == v for k, v in seen.items() if len(v) < 3)


def test_chunks_with_equal_terms_are_one_row(spark):
    rows = [("Word, word. (WORD) É-é 99 -- \x1f a.b'a", "en", "s"), ("word! a:B:a", "en", "t"), ("...", "en", "s")]
    df = spark.createDataFrame([(None, *r, "", 0) for r in rows], ROWS).repartition(3)
    groups, seed = divergence.group_ids(df)
    found = {tuple(r.terms): r.langs for r in divergence.chunk_counts(df, groups, seed).collect()}
    assert sorted(found) == [("a", "b", "a"), ("word",), ("É", "é")]
    (lang,) = found["word",]
    assert lang.docs == 2 and lang.lo != lang.hi and sorted(g.n for g in lang.groups) == [1, 3]


def test_divergences_of_odd_rows(spark, odd, none):  # noqa: F811
    rows = [(r.text, r.lang, r.source) for r in odd.collect()]
    assert got(odd) == plain(rows)
    assert got(none) == []


def test_sql_on_made_rows(spark):
    import duckdb
    import pandas as pd

    rows = [(n, *r) for n, r in enumerate(made(4))]
    docs = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"])  # noqa: F841
    sql = duckdb.connect().execute(divergence.divergence_sql("docs")).df()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert differences(divergence.divergences(df).toPandas(), sql) is None
