"""The corpus operators against plain versions on the smallest tables and on hand-made rows."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from newsloom.llm import columns, decontaminate, fingerprint, gru, labelled, lm, mixing, near_copies, pages, phrases, quality, registered, tokens, toxicity, wordhash
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"
ROWS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHES = ("score", "size", "hash", "row", "kept", "gram", "band", "copies", "spans", "label", "term", "_group", "hits", "id_key", "bits", "target")


def words(text):
    return (text or "").encode().split()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, repeats, ties, one very long text."""
    rng = random.Random(5)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(900)) for _ in range(30_000))
    base = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, base), (2, base), (2, base), (3, base + " tail"), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "one two"),
        (9, long), (10, "x " + base), (None, base), (None, None), (11, "\x00 ▁ é 　b"), (12, "Å" * 50), (13, "a\n\nb\r\nc"),
    ]
    rows = [(i, t, "en" if n % 3 else None, None if n % 4 == 0 else f"s{n % 2}", None if t is None else len(t)) for n, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, ROWS)
    for name in CLASHES:
        df = df.withColumn(name, F.lit(1))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], ROWS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.mark.parametrize("name", sorted(registered.ORACLES))
def test_sql(spark, name):
    got = registered.QUERIES[name](spark, SF).toPandas()
    assert differences(got, connect(SF).execute(registered.ORACLES[name]).df()) is None


# fingerprints


def test_equal_texts_have_equal_fingerprints(odd, none):
    rows = fingerprint.fingerprints(odd).collect()
    assert len(rows) == 16
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add((r.fingerprint, r.n_chars))
    assert by[1] == by[2] and by[4] == by[5] and by[7] == by[8]
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert fingerprint.fingerprints(none).count() == 0


def test_edited_text(spark):
    df = spark.createDataFrame([(3, "abcdef"), (2, "xy"), (1, "é" * 5)], "doc_id long, text string")
    got = {r.doc_id: r.edited_sha256 for r in fingerprint.fingerprints(df).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {3: sha("abcxy"), 2: sha("xé"), 1: sha("éééab")}


def test_subsets_of_a_fingerprint(docs):
    assert Counter(fingerprint.RATES) == {2: 2, 8: 4, 32: 8, 128: 8, 512: 8}
    assert {len(r.fingerprint.split("-")) for r in fingerprint.fingerprints(docs).collect() if not r.fingerprint.startswith("#")} == {30}


# near copies


def plain_components(found: dict, n: int) -> tuple[dict, dict]:
    sets = {}
    for i, t in found.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    have = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            have[x].add(i)
    for i, s in sets.items():
        for j in {j for x in s for j in have[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return sets, {i: find(i) for i in sets}


def chained(n: int, step: int) -> dict:
    """Texts of a window that moves on, so that only near ones are alike, and crowds around a template."""
    rng = random.Random(1)
    stream = [f"w{rng.randrange(10**6)}" for _ in range(n * step + 200)]
    out = {i: " ".join(stream[i * step : i * step + 100]) for i in range(n)}
    template = [f"t{i}" for i in range(120)]
    for i in range(n, 2 * n):
        copy = list(template)
        for _ in range(rng.randrange(5)):
            copy[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        out[i] = " ".join(copy)
    return out


@pytest.mark.parametrize("block", [1_500, 7])
def test_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    found = chained(60, 5)
    df = spark.createDataFrame(list(found.items()), "doc_id long, text string").repartition(4)
    sets, top = plain_components(found, 4)
    got = {r.doc_id: r for r in near_copies.near_copies(df).collect()}
    assert len(set(top.values())) > 1
    assert {i: r.component_id for i, r in got.items()} == top
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_near_copies_of_odd_rows(odd, none):
    rows = near_copies.near_copies(odd).collect()
    assert len(rows) == 16
    got = {r.doc_id: (r.component_id, r.kept) for r in rows if r.doc_id is not None}
    assert [got[i][0] for i in (1, 2, 3, 10, 4, 5, 6, 7, 8)] == [1, 1, 1, 1, 4, 5, 6, 7, 7]
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert near_copies.near_copies(none).count() == 0
    left = near_copies.without_near_copies(odd)
    assert left.columns == odd.columns and left.where("doc_id in (1, 2, 3, 10)").count() == 1


def test_near_copies_of_all_documents(spark):
    found = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    _, top = plain_components(found, 4)
    got = {r.doc_id: r.component_id for r in registered.QUERIES["op2_near_copies"](spark, "/root/testdata/sf0.01").collect()}
    assert got == top


def test_near_copies_of_repeated_ids(spark):
    """Rows that repeat an id with another text are documents of their own, and no text is lost."""
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    df = spark.createDataFrame([(1, a), (5, a), (5, b), (7, b), (5, "c"), (9, None)], "doc_id long, text string")
    got = sorted(tuple(r) for r in near_copies.near_copies(df).select("doc_id", "component_id", "kept").collect())
    assert got == [(1, 1, True), (5, 1, False), (5, 5, True), (5, 5, True), (7, 5, False), (9, 9, True)]
    left = sorted(((r.doc_id, r.text) for r in near_copies.without_near_copies(df).collect()), key=repr)
    assert left == sorted([(1, a), (5, b), (5, "c"), (9, None)], key=repr)


def test_blocks_are_cut_by_shingles(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "MOST_SHINGLES", 500)
    found = chained(40, 5)
    df = spark.createDataFrame(list(found.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(df).collect()} == plain_components(found, 4)[1]


def test_pruning_keeps_what_it_should():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**16, (4_000, near_copies.VALUES)).astype(np.uint16)
    b = np.where(rng.random(a.shape) < 0.8, a, a + 1)
    far = np.where(rng.random(a.shape) < 0.4, a, a + 1)
    assert len(near_copies.surviving(a, b)) > 3_990
    assert len(near_copies.surviving(a, far)) < 10


# mixing


def plain_targets(sizes: dict) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while True:
        whole = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / whole > 2 * sizes[s] + 1e-9}
        if not over:
            return out | {s: left * weight[s] / whole for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in over)
        free -= over


def test_mixing(spark, docs):
    rows = docs.select("doc_id", "source", "text").collect()
    source, size = {r.doc_id: r.source for r in rows}, {r.doc_id: len(words(r.text)) for r in rows}
    sizes, taken, longest = Counter(), Counter(), Counter()
    for i, s in source.items():
        sizes[s] += size[i]
        longest[s] = max(longest[s], size[i])
    targets = plain_targets(sizes)
    for r in mixing.mix(docs).collect():
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == sizes[s] and r.target == pytest.approx(targets[s])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    assert all(abs(taken[s] - targets[s]) <= longest[s] / 2 + 1e-6 for s in targets)


def test_mixing_of_odd_rows(odd, none):
    got = mixing.mix(odd)
    assert got.count() == 16 and got.where("taken > 2 * size or taken is null").count() == 0
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, mixing.mix(odd.repartition(3)).collect()), key=repr)
    assert mixing.mix(none).count() == 0
    mix = mixing.mixed(odd)
    assert mix.columns == [*odd.columns, "copy"]
    assert mix.agg(F.sum(F.regexp_count("text", F.lit(columns.WORD)))).first()[0] == got.agg(F.sum("taken")).first()[0]


# tokens


def test_token_counts(odd, texts, docs, none):
    import public_tokenizers
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    for frame in (docs, odd):
        for r, t in zip(tokens.token_counts(frame, model, 100).collect(), frame.collect()):
            n = len(library.encode(t.text or ""))
            assert (r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) == (t.doc_id, len((t.text or "").encode()), n, n > 100)
    assert tokens.token_counts(none, model).count() == 0
    rng, counts = random.Random(1), tokens.word_counts(model)
    for _ in range(5_000):
        t = "".join(rng.choice(" \n\t\r▁ab.,<s>é\xa0　ｆ中0\x00😀{}*/") for _ in range(rng.randrange(12)))
        assert counts.of(t.encode()) == len(library.encode(t)), t


def test_cuts_are_proved():
    with pytest.raises(ValueError):
        tokens.prove_cuts(["▁a", "a▁b"])


# pages

PAGE = "<html><head><title>t</title><style>p{{}}</style></head><body class='has-sidebar'><header>Site</header><nav><a>menu</a></nav>{}<footer>f</footer></body></html>"


def test_structure():
    page = PAGE.format("<div id='cookie-notice'>C</div><main><p class=lead>One &amp; two<ul><li>a<li>b</ul><div class='comments'><p>bad</div><p>end &lt;b&gt; <b>bo</b>ld<br>x</main>")
    texts = lambda html: [t for kind, t in pages.parse(html) if kind != pages.FURNITURE]
    assert texts(page) == ["One & two", "a", "b", "end <b> bold x"]
    assert [kind for kind, t in pages.parse(page) if t in ("One & two", "a", "C", "bad", "f")] == [pages.FURNITURE, pages.AUTHOR, pages.PLAIN, pages.FURNITURE, pages.FURNITURE]
    assert texts("<p>a<p>b<div class=ad>no</div>tail <script>x<y</script> <!-- c --> end<a hr") == ["a", "b", "tail end"]
    assert texts("<main><p>Press <button>this</button> here</p></main>") == ["Press here"]


def plain_pages(rows: list) -> dict:
    """Texts of (page_id, url, html) from the whole table at once: groups, order, nearer neighbour that is no copy, deletion."""
    found = []
    for page_id, url, html in rows:
        host, path = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*))?([^?#]*)", url or "").groups()
        lines = pages.parse(html or "")
        own = [t for kind, t in lines if kind == pages.AUTHOR]
        found.append(((host or "").lower(), path, page_id, lines, bool(own), tuple(own or [t for kind, t in lines if kind == pages.PLAIN])))
    heads: dict = {}
    for row in sorted(found, key=lambda r: r[:3]):
        heads.setdefault((row[0], row[4], row[5]), row)
    order, partner = sorted(heads.values(), key=lambda r: r[:3]), {}
    for n, head in enumerate(order):
        near = [(-len(os.path.commonprefix([head[1], order[m][1]])), m > n, order[m][3]) for m in (n - 1, n + 1) if 0 <= m < len(order) and order[m][0] == head[0]]
        kind, most = (pages.AUTHOR, 0.5) if head[4] else (pages.PLAIN, 0.9)
        for _, _, other in sorted(near, key=lambda x: x[:2]):
            shared = pages.shared_lines([t for _, t in head[3]], [t for _, t in other])
            if sum(len(head[3][i][1]) for i in shared if head[3][i][0] == kind) <= most * sum(len(t) for k, t in head[3] if k == kind):
                partner[head[0], head[4], head[5]] = other
                break
    out = {}
    for host, _, page_id, lines, authored, own in found:
        other = partner.get((host, authored, own))
        shared = pages.shared_lines([t for _, t in lines], [t for _, t in other]) if other is not None else set()
        out[page_id] = "\n\n".join(t for i, (kind, t) in enumerate(lines) if kind == pages.AUTHOR or (kind == pages.PLAIN and i not in shared))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_pages_against_a_plain_version(spark, seed):
    rng = random.Random(seed)
    line = lambda i: rng.choice(["<div>Read more</div>", "<li>Share this</li>", "<p>Notice of the house</p>", f"<p>story {i} {rng.randrange(99)}</p>", f"<div>list {rng.randrange(5)}</div>", "<nav>Home</nav>", "<table><tr><td>1<td>2</table>"])
    rows = []
    for i in range(120):
        body = "".join(line(i) for _ in range(rng.randrange(1, 9)))
        html = rng.choice(["{}", "<main>{}</main>", "<div>{}</div>", "<p>top</p><article>{}</article><div>end</div>"]).format(body)
        rows.append((i, f"http://h{rng.randrange(3)}/{rng.choice('ab')}/{rng.randrange(30)}", rng.choice(rows)[2] if rows and rng.random() < 0.2 else html))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert {r.page_id: r.text for r in pages.main_texts(df).collect()} == plain_pages(rows)


def test_pages_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert {r.page_id: r.text for r in registered.QUERIES["op5_main_texts"](spark, SF).collect()} == plain_pages(rows)
    # most of what is not the main text is what neighbours have, too
    gone = pages.removed_lines(pages.parsed_pages(spark.read.parquet(f"{SF}/pages.parquet"))).agg(F.sum("shared"), F.sum("listed")).first()
    assert gone[0] > 0


def test_odd_pages_take_little_time(spark):
    began = time.time()
    same = ["x"] * 20_000
    assert len(pages.shared_lines(["a", *same, "b"], ["c", *same, "d"])) == 20_000
    mixed = [str(i % 7) for i in range(5_000)]
    assert len(pages.shared_lines(mixed, mixed[3:] + ["z"] + mixed[:3])) >= 4_997
    pages.parse("".join(f"<b{i % 50}><i>x</u></q>" for i in range(40_000)))
    pages.parse("<p><b>" * 20_000 + "<div>" * 20_000 + "text")
    assert time.time() - began < 20
    rows = [(None, "http://h/a", "<p>" + "word " * 200_000), (1, None, "<div>" * 3_000 + "deep"), (None, None, None)]
    wide = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("row", "mark", "marks", "gone", "text", "lines", "plain", "_group")})
    assert sorted(r.n_chars for r in pages.main_texts(wide).collect()) == [0, 4, 999_999]


def test_differences_between_neighbours(spark, none):
    shared = "<div>Read more stories like this</div>"
    rows = [(i, f"http://H.example/a/{i}", PAGE.format(f"{shared}<p>story {i} with text of its own {i * 7}</p><div>share this</div>")) for i in range(6)]
    rows += [(6, "http://h.example/a/5?x=1", rows[5][2]), (7, None, None), (8, "http://other.example/", PAGE.format(f"<article>{shared}<p>kept</p></article>")), (9, "x", "")]
    got = {r.page_id: r.text for r in pages.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1))).collect()}
    assert [got[i] for i in range(6)] == [f"story {i} with text of its own {i * 7}" for i in range(6)]
    assert "story 5" in got[6]  # its only neighbour is its copy
    assert got[7] == "" and got[9] == "" and got[8] == "Read more stories like this\n\nkept"
    assert pages.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_copies_are_compared_as_one(spark):
    page = "<main><ul><li>Read more</li></ul><p>{}</p><div>share this</div></main>"
    text = lambda i: f"story {i} with text of its own {i * 7}"
    rows = [(i, f"http://h.example/a/{i}", PAGE.format(page.format(text(i)))) for i in range(3)]
    rows += [(10 + i, f"http://h.example/a/1?page={i}", rows[1][2]) for i in range(5)]
    rows += [(20, "http://h.example/a/1?utm_source=x", PAGE.format(page.format(text(1) + "</p><div>of this copy only</div><p>"))), rows[2], rows[2], rows[2]]
    found = pages.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(found) == len(rows)
    assert {r.text for r in found if r.page_id in (1, *range(10, 15))} == {text(1)}
    assert {r.text for r in found if r.page_id == 2} == {text(2)}
    assert [r.text for r in found if r.page_id == 20] == [text(1) + "\n\nof this copy only"]


def test_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert len(pages.shared_lines(a, b)) == best[-1][-1]


# classifiers


def test_toxicity_finds_altered_insults(spark):
    rng = random.Random(4)
    syllables = "th er on an re he in ed nd ha at en es of".split()
    text = lambda: " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(40))
    rows, marks = [], []
    for i in range(600):
        bad = i % 3 == 0
        rows.append((i, text() + (rng.choice([" blockhead ", " nitwit "]) if bad else " ") + text()))
        marks.append((i, int(bad)))
    tests = ["blo-ckhead", "b l o c k h e a d", "blockkhead", "nitt-wit"]
    rows += [(1_000 + n, f"{text()} {t} {text()}") for n, t in enumerate(tests)] + [(2_000 + n, text()) for n in range(40)]
    got = {r.doc_id: r for r in toxicity.toxicity_scores(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert [got[i].held_out for i in range(600)] == [i in set(held) for i in range(600)]
    assert np.mean([got[i].predicted == (i % 3 == 0) for i in held]) > 0.97
    clean = np.median([got[2_000 + n].score for n in range(40)])
    assert all(got[1_000 + n].score > clean for n in range(len(tests)))


def test_toxicity_of_odd_rows(spark, odd, none, labels):
    rows = toxicity.toxicity_scores(odd, labels).collect()
    assert len(rows) == 16 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxicity_scores(none, labels).count() == 0
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.score == pytest.approx(0.5) for r in toxicity.toxicity_scores(odd, empty).collect())


def test_quality(docs, labels):
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    known = [(got[r.doc_id], r.quality) for r in labels.collect()]
    assert np.mean([g.predicted == q for g, q in known]) > 0.85
    assert all(g.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, g in got.items())


def test_quality_of_odd_rows(spark, odd, none, labels):
    rows = quality.quality_scores(odd, labels).collect()
    assert len(rows) == 16 and all(0 <= r.score <= 1 for r in rows)
    assert quality.quality_scores(none, labels).count() == 0
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.quality_scores(odd, empty).collect()} == {0.5}
    assert quality.good(odd, labels).columns == odd.columns


def test_trees_are_walked_as_grown():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2_000, len(quality.NAMES)))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert np.mean((model.score(x) >= 0.5) == y) > 0.97


@pytest.fixture
def capped(spark):
    """Labelled documents, one in five of class 1; more than 60 of each class are usable."""
    rng = random.Random(6)
    text = lambda bad: " ".join(rng.choice(["ab", "cd ef", "gh.", "ij"]) for _ in range(30)) + (" blockhead" if bad else "")
    rows = [(i, text(i % 5 == 0), int(i % 5 == 0)) for i in range(1_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    return df.select("doc_id", "text"), df.select("doc_id", F.col("label").alias("quality"), F.col("label").alias("toxic"))


def usable(folds: int, held: int) -> list:
    """Labels of the rows of ``capped`` that may teach."""
    return [int(i % 5 == 0) for i in range(1_000) if zlib.crc32(str(i).encode()) % folds != held]


def test_capped_classes_keep_their_shares(capped, monkeypatch):
    sample = labelled.label_sample(capped[1], "toxic", toxicity.FOLDS, toxicity.HELD, 60).collect()
    left = usable(toxicity.FOLDS, toxicity.HELD)
    assert Counter(r.label for r in sample) == {0: 60, 1: 60}
    assert [sum(r.weight for r in sample if r.label == k) for k in (0, 1)] == pytest.approx([left.count(0), left.count(1)])
    whole = labelled.label_sample(capped[1], "toxic", toxicity.FOLDS, toxicity.HELD, 1_000).collect()
    assert len(whole) == len(left) and {r.weight for r in whole} == {1.0}

    monkeypatch.setattr(quality, "TRAIN_ROWS", 60)
    share = np.mean(usable(quality.FOLDS, quality.HELD))
    model = quality.train(*capped)
    assert model.base == pytest.approx(math.log(share / (1 - share)))


def test_capped_toxicity_has_the_scores_of_all_rows(capped, monkeypatch):
    def mean() -> float:
        return np.mean([r.score for r in toxicity.toxicity_scores(*capped).collect()])

    whole = mean()
    monkeypatch.setattr(toxicity, "TRAIN_DOCS", 60)
    assert mean() == pytest.approx(whole, abs=0.05)
    x = np.zeros(120)
    slope, shift = toxicity.curve(x, np.arange(120) % 2.0, np.where(np.arange(120) % 2, 1.0, 4.0))
    assert 1 / (1 + math.exp(-shift)) == pytest.approx(0.2, abs=0.01)


def test_capped_trees_weigh_their_rows():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2_000, len(quality.NAMES)))
    y = (np.arange(2_000) % 2).astype(float)
    weighted = quality.fit(x, y, np.where(y > 0, 1.0, 9.0)).score(x)
    assert np.average(weighted, weights=np.where(y > 0, 1.0, 9.0)) == pytest.approx(0.1, abs=0.01)


# language model


def test_gradients():
    model = gru.Gru([0, 1, 4, 9], 5)
    model.begin(np.array([5, 3, 2, 1, 1.0]), np.arange(9.0))
    model.vector = model.vector.astype(np.float64)
    model.p = model.views(model.vector)
    rng = np.random.default_rng(0)
    x, c = rng.integers(0, model.start + 1, (6, 3)), rng.integers(0, 5, (6, 3))
    w = np.where(c < 3, model.bounds[np.minimum(c, 2)], -1)
    fresh, start = rng.random((6, 3)) < 0.2, rng.normal(size=(3, gru.HIDDEN))

    def loss():
        h, total = start, 0.0
        for t in range(6):
            h = model.step(x[t], np.where(fresh[t][:, None], 0, h))
            total -= np.log(10) * 0 + sum(plain_log_prob(model, h[b], c[t, b], w[t, b]) for b in range(3))
        return total / 18

    gradient, _ = model.window(x, c, w, fresh, start)
    for i in rng.integers(0, len(model.vector), 40):
        old = model.vector[i]
        model.vector[i] = old + 1e-5
        up = loss()
        model.vector[i] = old - 1e-5
        down = loss()
        model.vector[i] = old
        assert abs((up - down) / 2e-5 - gradient[i]) < 1e-6


def plain_log_prob(model, h, c, w):
    p = model.p
    out = gru.log_softmax((p["c"] @ h + p["cb"])[None])[0, c]
    if w >= 0:
        low, high = model.bounds[c], model.bounds[c + 1]
        out += gru.log_softmax((p["w"][low:high] @ h + p["wb"][low:high])[None])[0, w - low]
    return out


@pytest.mark.parametrize("weight, bounded", [(0.1, True), (300, False)])
def test_scores_of_any_size(weight, bounded):
    model = gru.Gru([0, 2, 5], 4)
    model.begin(np.ones(4), np.ones(5))
    model.p["c"][1], model.p["w"][3] = weight, -weight
    assert model.bounded() == bounded
    rng = np.random.default_rng(2)
    states, c = rng.uniform(-1, 1, (50, gru.HIDDEN)).astype(np.float32), rng.integers(0, 4, 50)
    w = np.where(c < 2, model.bounds[np.minimum(c, 1)], -1)
    found = model.log_probs(states, c, w)
    assert found == pytest.approx([plain_log_prob(model, *row) for row in zip(states, c, w)], rel=1e-3, abs=1e-5)
    gradient, h = model.window(c[:48].reshape(16, 3), c[:48].reshape(16, 3), w[:48].reshape(16, 3), np.zeros((16, 3), bool), states[:3])
    assert np.isfinite(gradient).all() and np.isfinite(h).all()


def test_state_is_carried_over_windows():
    model = gru.Gru([0, 2, 5], 4)
    model.begin(np.ones(4), np.ones(5))
    rng = np.random.default_rng(1)
    found = []
    for n in (1, 3, 40, gru.STEPS, gru.STEPS + 1):
        c = rng.integers(0, 4, n)
        w = np.where(c < 2, model.bounds[np.minimum(c, 1)], -1)
        found.append((rng.integers(0, model.start, n), c, w))
    for got, (x, c, w) in zip(model.score(found), found):
        h, total, before = np.zeros((1, gru.HIDDEN), np.float32), 0.0, model.start
        for t in range(len(x)):
            h = model.step(np.array([before]), h)
            total += plain_log_prob(model, h[0], c[t], w[t])
            before = x[t]
        assert got == pytest.approx(total, rel=1e-4)


@pytest.mark.parametrize("known", [200_000, 1_700])
def test_language_model(docs, texts, monkeypatch, known):
    monkeypatch.setattr(lm, "KNOWN", known)
    monkeypatch.setattr(lm, "SCORED", 5_000)
    toks = {i: [*(t or "").encode().lower().split(), b""] for i, t in texts.items()}
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    c = Counter(w for i in texts if i not in held for w in toks[i])
    n, v = sum(c.values()), len(c)
    rows = lm.scores(docs).collect()
    for r in rows:
        t = toks[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id in held, len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_every_training_document_teaches(spark, monkeypatch):
    rows = [(i, " ".join([f"only{i}"] * 3)) for i in range(150)]
    fits, learned = [], lm.learned

    def watched(taught, lexicon):
        fits.append((lexicon, learned(taught, lexicon)))
        return fits[0][1]

    monkeypatch.setattr(lm, "learned", watched)
    lm.scores(spark.createDataFrame(rows, "doc_id long, text string"))
    lexicon, vector = fits[0]
    before, after = lexicon.model(), lexicon.model()
    before.begin(lexicon.class_counts, lexicon.head_counts)
    after.set(vector)
    moved = (before.p["x"] != after.p["x"]).any(axis=1)  # a word's input weights learn from its own documents only
    taught = [i for i in range(150) if zlib.crc32(str(i).encode()) % 7 != 2]
    assert len(taught) < 150 and all(moved[lexicon.entries[f"only{i}".encode()]] for i in taught)


def test_leftover_tokens_teach():
    n = gru.STREAMS * 2 * gru.STEPS + 5
    model = gru.Gru([0, 2, 5], 4)
    model.begin(np.ones(4), np.ones(5))
    x = np.zeros(n, np.int64)
    x[-3] = 4
    fresh = np.arange(n) == 0
    before = model.p["x"][4].copy()
    model.train(x, np.ones(n, np.int64), np.full(n, 3), fresh)
    assert (model.p["x"][4] != before).any()


def test_language_model_of_odd_rows(odd, none):
    rows = lm.scores(odd).collect()
    assert len(rows) == 16 and all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (4, 5, 6)} == {1}
    assert lm.scores(none).count() == 0


# phrases


def plain_repeats(found: list) -> list:
    first = {}
    for i, w in found:
        for k in range(len(w) - 12):
            window = tuple(w[k : k + 13])
            first[window] = min(first.get(window, i), i)
    out = []
    for i, w in found:
        drop = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                drop[k : k + 13] = [True] * 13
        out.append((i, len(w), sum(drop), hashlib.sha256(b" ".join(x for x, d in zip(w, drop) if not d)).hexdigest()))
    return sorted(out)


def passages(seed: int) -> list:
    rng = random.Random(seed)
    pool = [[f"p{i}_{k}" for k in range(rng.randrange(8, 40))] for i in range(6)]
    out = []
    for i in range(80):
        text = []
        for _ in range(rng.randrange(5)):
            text += [rng.choice("abc") for _ in range(rng.randrange(16))] + rng.choice(pool)
        out.append((i, " ".join(text)))
    return out


@pytest.mark.parametrize("crowd", [100_000, 3])
def test_repeated_phrases(spark, monkeypatch, crowd):
    monkeypatch.setattr(phrases, "CROWD", crowd)
    found = passages(crowd)
    df = spark.createDataFrame(found, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, phrases.repeat_digest(df).collect())) == plain_repeats([(i, words(t)) for i, t in found])


def test_repeated_phrases_in_documents(docs, texts):
    assert sorted(map(tuple, phrases.repeat_digest(docs).collect())) == plain_repeats([(i, words(t)) for i, t in texts.items()])


def test_repeated_phrases_of_odd_rows(odd, none):
    rows = phrases.repeat_digest(odd).collect()
    got = {r.doc_id: r.n_removed for r in rows if r.doc_id is not None}
    assert len(rows) == 16 and [got[i] for i in (1, 2, 3, 10, 4, 7, 8)] == [0, 60, 60, 60, 0, 0, 0]
    assert all(r.n_removed == 0 for r in rows if r.doc_id is None)
    left = phrases.without_repeats(odd)
    assert left.columns == odd.columns and left.where("doc_id = 3").first().text == "tail" and left.where("doc_id = 2").count() == 0
    assert left.where("doc_id = 4").first().text is None and left.where("doc_id = 5").first().text == ""
    assert phrases.repeat_digest(none).count() == 0


def test_words_are_hashed_like_split():
    texts = ["a b", None, "", " a\tb\x0b\x0c", "é\x1c漢\x85字 é", "long" * 100, "x" * 8, "x" * 9 + "\n" + "x" * 8]
    column = pa.array(["skipped", *texts]).slice(1)
    found, starts = wordhash.byte_hashes(column)
    words = [(t or "").encode().split() for t in texts]
    assert np.diff(starts).tolist() == [len(w) for w in words]
    flat = [w for part in words for w in part]
    assert len(set(zip(flat, found.tolist()))) == len(set(flat)) == len(set(found.tolist()))
    assert [len(x) for x in wordhash.byte_hashes(column[:0])] == [0, 1]


def test_only_stretches_with_later_windows_are_compiled():
    passage, other = (" ".join(f"{c}{i}" for i in range(15)) for c in "pq")
    shard = {"id_key": [3, 1, 2, 3], "text_key": [30, 10, 20, 30], "place": [7, 0, 4, 90], "words": [passage.encode(), passage.encode(), other.encode(), other.encode() + b" z"]}
    ids = np.array(shard["id_key"])
    words, starts = wordhash.byte_hashes(pa.array(shard["words"]))
    places, first, later = phrases.recurring_windows(ids, words, starts)
    assert later.tolist() == [0, 3] and sorted(first.tolist()) == [1, 1, 1, 2, 2, 2]
    found = phrases.match_shard(pa.table(shard)).to_pylist()
    assert sorted((r["id_key"], r["text_key"], r["place"], r["length"]) for r in found) == [(3, 30, 7, 15), (3, 30, 90, 15)]


# benchmark


def plain_distance(item, text):
    row, place = np.zeros(len(text) + 1, int), np.arange(len(text) + 1)
    for i, c in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (text != c), row[1:] + 1)
        row = np.minimum.accumulate(new - place) + place
    return row.min()


def test_benchmark_matches(spark, odd, none):
    rng = random.Random(3)
    vocabulary = "the of and in to inges thder onren athing ouble".split()
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "x", "ing"]) for _ in range(n))
    items = [(i, text(rng.randrange(3, 40))) for i in range(12)] + [(12, None), (13, "short")]
    found = []
    for i in range(100):
        letters = list(rng.choice(items[:12])[1])
        for _ in range(rng.randrange(int(len(letters) * 0.12) + 1)):
            p = rng.randrange(len(letters))
            letters[p : p + rng.randrange(2)] = rng.choice(["", "q", "é "])
        found.append((i, f"{text(rng.randrange(30))}\n {''.join(letters)}  {text(rng.randrange(30))}"))
    expected = {}
    for i, t in found:
        for n, item in items[:12]:
            a, b = decontaminate.normal(item.encode()), decontaminate.normal(t.encode())
            if len(a) >= decontaminate.SHORTEST and (d := plain_distance(a, b)) <= decontaminate.budget(len(a)):
                expected[i, n] = d
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(found, "doc_id long, text string")
    assert {(r.doc_id, r.item_id): r.edits for r in decontaminate.matches(df, benchmark).collect()} == expected and expected
    clean = decontaminate.decontaminated(df, benchmark)
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in found} - {i for i, _ in expected}
    assert decontaminate.matches(odd, benchmark).count() == 0 and decontaminate.decontaminated(odd, benchmark).columns == odd.columns
    assert decontaminate.matches(none, benchmark).count() == 0 and decontaminate.matches(df, benchmark.limit(0)).count() == 0


def test_benchmark_in_parts(spark, monkeypatch, docs):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = set(map(tuple, decontaminate.matches(docs, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "PART", 9_000)
    monkeypatch.setattr(decontaminate, "CHUNK", 5_000)
    assert set(map(tuple, decontaminate.matches(docs, benchmark).collect())) == whole and whole


# pipeline


def test_stages(spark, docs, labels):
    current = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in current.select("doc_id", "text").collect()}
        after = columns.saved(stage(spark, current, SF))
        now = {r.doc_id: r.text for r in after.select("doc_id", "text").collect()}
        if name != "mixing":
            assert after.columns == docs.columns
        if name == "quality":
            scores = {r.doc_id for r in quality.quality_scores(current, labels).where("predicted = 1").collect()}
            assert now == {i: t for i, t in before.items() if i in scores}
        if name == "near_copies":
            _, top = plain_components(before, corpus_pipeline.SHINGLE)
            assert now == {i: t for i, t in before.items() if top[i] == i}
        if name == "repeated_phrases":
            expected = {i: h for i, n, removed, h in plain_repeats([(i, words(t)) for i, t in before.items()]) if removed < n or not n}
            assert {i: hashlib.sha256(b" ".join(words(t))).hexdigest() for i, t in now.items()} == expected
        if name == "decontamination":
            items = {r.item_id: b" ".join(words(r.text.lower())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
            hit = {i for i, t in before.items() if any(x in b" ".join(words(t.lower())) for x in items.values())}
            assert hit <= set(before) - set(now)
        current = after
    assert current.count()


def test_stages_take_odd_and_empty_tables(spark, odd, none):
    for _, stage in corpus_pipeline.STAGES:
        odd, none = columns.saved(stage(spark, odd, SF)), stage(spark, none, SF)
        assert none.count() == 0
