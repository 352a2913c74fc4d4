"""Vector search, trees and clusters against plain brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom.operators import vector_search as vs
from newsloom.operators import cluster, embed, reachability, similarity
from newsloom import registry as queries
from newsloom.operators.blocks import Sketch, TopMatches
from newsloom.operators.lsh import Lsh, plan
from newsloom.operators.vector_search import knn
from newsloom.operators.cluster import cluster_vectors, neighbours, reachability_tree
from newsloom.operators.forest import components, spanning_forest
from newsloom.operators.similarity import top_matches

BLOCKED = {"max_sent": 0, "block_rows": 16}


def clustered_points(n, dim, seed, centres=12, spread=0.15):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    points = middle[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim))
    points[n // 2 : n // 2 + n // 3] = points[0]  # a third of all rows are copies
    return points.astype(np.float32)


def frame(spark, points, id_col="id", prefix="v", **extra):
    rows = [
        (f"{prefix}{i:04d}", [float(x) for x in p], *[col[i] for col in extra.values()])
        for i, p in enumerate(points)
    ]
    names = "".join(f", {k} long" for k in extra)
    return spark.createDataFrame(rows, f"{id_col} string, embedding array<float>{names}").repartition(5)


def unit(points):
    p = points.astype(np.float64)
    return p / np.linalg.norm(p, axis=1, keepdims=True)


def brute_top(q, s, q_ids, s_ids, k, min_score, allowed=lambda i, j: True):
    scores = np.round(unit(q) @ unit(s).T, 12)
    out = set()
    for i in range(len(q)):
        order = sorted(
            (j for j in range(len(s)) if allowed(i, j) and (min_score is None or scores[i, j] >= min_score)),
            key=lambda j: (-scores[i, j], s_ids[j]),
        )
        out |= {(q_ids[i], s_ids[j], r + 1) for r, j in enumerate(order[:k])}
    return out


@pytest.mark.parametrize("tuning", [{}, BLOCKED])
@pytest.mark.parametrize("k, min_score", [(1, 0.95), (5, 0.3), (4, None)])
def test_top_matches_equals_brute_force(spark, tuning, k, min_score):
    stored, queries = clustered_points(150, 8, 1), clustered_points(70, 8, 1)[::-1].copy()
    got = top_matches(
        frame(spark, queries, prefix="q"), frame(spark, stored), k, min_score, **tuning
    ).collect()
    q_ids, s_ids = [f"q{i:04d}" for i in range(70)], [f"v{i:04d}" for i in range(150)]
    expected = brute_top(queries, stored, q_ids, s_ids, k, min_score)
    assert {(r["query_id"], r["article_id"], r["rank"]) for r in got} == expected
    assert len(got) == len(expected)


@pytest.mark.parametrize("tuning", [{}, BLOCKED])
def test_top_matches_of_a_set_with_itself_in_order(spark, tuning):
    points = clustered_points(120, 6, 2)
    seq = [i // 10 for i in range(120)]
    df = frame(spark, points, seq=seq)
    got = top_matches(df, df, 3, 0.5, skip_self=True, **tuning).collect()
    ids = [f"v{i:04d}" for i in range(120)]
    expected = brute_top(points, points, ids, ids, 3, 0.5, lambda i, j: i != j and seq[j] < seq[i])
    assert {(r["query_id"], r["article_id"], r["rank"]) for r in got} == expected


def test_knn_filters_before_scoring(spark):
    vectors = frame(spark, clustered_points(40, 4, 3), "article_id").withColumns(
        {
            "region": F.when(F.col("article_id") < "v0020", "europe").otherwise("asia"),
            "source_feed": F.lit("f"),
            "published_at": F.when(F.col("article_id") != "v0003", F.lit("2024-01-01").cast("timestamp")),
        }
    )
    query = frame(spark, clustered_points(1, 4, 3), "query_id", "q")
    got = vs.knn(vectors, query, 100, None, region="europe", since=F.lit("2023-12-31").cast("timestamp"))
    found = {r["article_id"] for r in got.collect()}
    assert found == {f"v{i:04d}" for i in range(20) if i != 3}


@pytest.mark.parametrize("finish_rows", [0, 5, 4096])
def test_dedup_in_order_equals_feed_by_feed(spark, finish_rows):
    points = clustered_points(90, 5, 4, centres=8, spread=0.12)
    seq = [i % 6 for i in range(90)]
    batch = frame(spark, points, "article_id", batch_seq=seq)
    stored = frame(spark, points[:2] * 3, "article_id", "s")
    got = {r["article_id"] for r in vs.dedup_vectors_in_order(batch, stored, 0.9, finish_rows).collect()}
    u = unit(points)
    kept = []
    for feed in range(6):
        mine = [i for i in range(90) if seq[i] == feed]
        base = [*kept]
        for i in mine:
            near_stored = (u[:2] @ u[i] >= 0.9).any()
            if not near_stored and not any(u[j] @ u[i] >= 0.9 for j in base):
                kept.append(i)
    assert got == {f"v{i:04d}" for i in kept}


def brute_mst_weights(points, k):
    u = unit(points)
    d = np.sqrt(np.maximum(2 - 2 * np.round(u @ u.T, 12), 0))
    core = np.sort(d, axis=1)[:, k]
    reach = np.maximum(np.maximum(d, core[:, None]), core[None, :])
    n = len(points)
    best, done, out = np.full(n, np.inf), np.zeros(n, bool), []
    source = np.zeros(n, int)
    current = 0
    edges = []
    for _ in range(n - 1):
        done[current] = True
        closer = ~done & (reach[current] < best)
        best[closer], source[closer] = reach[current][closer], current
        current = int(np.argmin(np.where(done, np.inf, best)))
        edges.append((source[current], current, best[current]))
    return edges


@pytest.mark.parametrize("block_rows", [2048, 17])
def test_reachability_tree_has_minimum_weight(spark, block_rows):
    points = clustered_points(80, 6, 5)
    tree = reachability_tree(frame(spark, points, "article_id"), 3, block_rows).collect()
    expected = sorted(w for _, _, w in brute_mst_weights(points, 3))
    assert len(tree) == 79
    assert np.allclose(sorted(r["w"] for r in tree), expected, atol=1e-7)


def far_groups(rng) -> np.ndarray:
    """Tight groups larger than a row's list, far apart, with copies and far points: rounds without a known edge."""
    centres = rng.normal(size=(4, 6))
    groups = [c + 0.01 * rng.normal(size=(30, 6)) for c in centres]
    copies = np.tile(rng.normal(size=6), (35, 1))
    return np.vstack([*groups, copies, rng.normal(size=(8, 6))]).astype(np.float32)


@pytest.mark.parametrize("cell_rows, block_rows", [(4, 7), (40, 1000), (10**6, 1000)])
def test_tree_in_cells(spark, monkeypatch, cell_rows, block_rows):
    monkeypatch.setattr(cluster, "CELL_ROWS", cell_rows)
    points = far_groups(np.random.default_rng(cell_rows))
    tree = reachability_tree(frame(spark, points, "article_id"), 3, min(block_rows, 100)).collect()
    top = list(range(len(points)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for r in tree:  # no cycle
        a, b = find(int(r["a"][1:])), find(int(r["b"][1:]))
        assert a != b
        top[a] = b
    expected = sorted(w for _, _, w in brute_mst_weights(points, 3))
    assert np.allclose(sorted(r["w"] for r in tree), expected, atol=1e-7)


def test_tree_visits_few_cells(spark, monkeypatch):
    """Rows inside a component far from all others visit no cell: visits stay far below rows times cells."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8))
    points = np.vstack([c + 0.02 * rng.normal(size=(60, 8)) for c in centres]).astype(np.float32)
    visits = []
    route = reachability._route
    monkeypatch.setattr(reachability, "_route", lambda looking, cells: (visits.append((route(looking, cells).count(), len(cells.ids))), route(looking, cells))[1])
    monkeypatch.setattr(cluster, "CELL_ROWS", 10)
    tree = reachability_tree(frame(spark, points, "article_id"), 3, 100)
    assert tree.count() == len(points) - 1
    assert visits and sum(v for v, _ in visits) < len(points) * visits[0][1] / 4


def textbook_labels(edges, n, m):
    """HDBSCAN* as published, top down: dendrogram, condensed tree, excess of mass."""
    size, children = {i: 1 for i in range(n)}, {}
    top = {i: i for i in range(n)}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    nxt = n
    for w in sorted({e[2] for e in edges}):
        level = [(int(a), int(b)) for a, b, v in edges if v == w]
        roots = {find(x) for e in level for x in e}
        groups = [{r} for r in roots]
        for a, b in level:
            ga = next(g for g in groups if find(a) in g)
            gb = next(g for g in groups if find(b) in g)
            if ga is not gb:
                groups.remove(gb)
                ga |= gb
        for g in groups:
            children[nxt] = (sorted(g), w)
            size[nxt] = sum(size[c] for c in g)
            top[nxt] = nxt
            for c in g:
                top[c] = nxt
            nxt += 1

    def leaves(x):
        stack, out = [x], []
        while stack:
            y = stack.pop()
            if y < n:
                out.append(y)
            else:
                stack += children[y][0]
        return out

    clusters = {}  # id -> dict(birth, parent, stability, kids, points)

    def condense(node, cid):
        while True:
            if node < n:
                return
            kids, w = children[node]
            lam = 1 / max(w, 1e-6)
            big = [c for c in kids if size[c] >= m]
            if len(big) > 1:
                for c in kids:
                    if c not in big:
                        clusters[cid]["stab"] += size[c] * (lam - clusters[cid]["birth"])
                        clusters[cid]["points"] += leaves(c)
                for c in big:
                    kid = len(clusters)
                    clusters[kid] = {"birth": lam, "stab": 0.0, "kids": [], "points": []}
                    clusters[cid]["kids"].append(kid)
                    clusters[cid]["stab"] += size[c] * (lam - clusters[cid]["birth"])
                    condense(c, kid)
                return
            for c in kids:
                if c not in big:
                    pts = leaves(c)
                    clusters[cid]["stab"] += len(pts) * (lam - clusters[cid]["birth"])
                    clusters[cid]["points"] += pts
            if not big:
                return
            node = big[0]

    clusters[0] = {"birth": 0.0, "stab": 0.0, "kids": [], "points": []}
    condense(nxt - 1, 0)

    def best(c):
        below = sum(best(k) for k in clusters[c]["kids"])
        clusters[c]["chosen"] = c != 0 and clusters[c]["stab"] >= below
        return max(clusters[c]["stab"], below) if c else below

    best(0)
    groups = []

    def all_points(c):
        return clusters[c]["points"] + [p for k in clusters[c]["kids"] for p in all_points(k)]

    def walk(c):
        if clusters[c]["chosen"]:
            groups.append(frozenset(all_points(c)))
        else:
            for k in clusters[c]["kids"]:
                walk(k)

    walk(0)
    return set(groups)


def groups_of(rows):
    found = {}
    for r in rows:
        found.setdefault(r["story"], set()).add(int(r["article_id"][1:]))
    return {frozenset(g) for g in found.values()}


@pytest.mark.parametrize("seed", [11, 12])
@pytest.mark.parametrize("tuning", [{}, {"tree_block_rows": 19, "slice_edges": 25}])
def test_clusters_equal_the_textbook_method(spark, seed, tuning):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 5))
    points = np.vstack(
        [centres[i % 6] + rng.uniform(0.02, 0.3) * rng.normal(size=5) for i in range(60)]
        + [rng.normal(size=5) for _ in range(12)]
    ).astype(np.float32)
    got = groups_of(cluster_vectors(frame(spark, points, "article_id"), 3, **tuning).collect())
    expected = textbook_labels(brute_mst_weights(points, 3), len(points), 3)
    assert got == expected
    assert expected


def test_tight_groups_are_clusters_and_far_points_noise(spark):
    rng = np.random.default_rng(7)
    for dim in (2, 64):
        basis = np.eye(dim)[0], np.eye(dim)[1], -np.eye(dim)[0]
        points = [b + 0.01 * rng.normal(size=dim) for b, n in zip(basis, (5, 4, 2)) for _ in range(n)]
        points = np.array(points, dtype=np.float32)
        got = groups_of(cluster_vectors(frame(spark, points, "article_id"), 3).collect())
        assert got == {frozenset(range(5)), frozenset(range(5, 9))}


def test_copies_cut_by_slices_stay_one_cluster(spark):
    rng = np.random.default_rng(3)
    points = np.vstack([np.tile(rng.normal(size=4), (25, 1)), np.tile(rng.normal(size=4), (10, 1)), rng.normal(size=(6, 4))])
    df = frame(spark, points.astype(np.float32), "article_id")
    got = groups_of(cluster_vectors(df, 3, slice_edges=4).collect())
    points = points.astype(np.float32)
    assert got == textbook_labels(brute_mst_weights(points, 3), len(points), 3)
    assert any(set(range(25)) <= g for g in got) and any(set(range(25, 35)) <= g for g in got)


def test_too_few_vectors_give_no_cluster(spark):
    assert cluster_vectors(frame(spark, np.eye(2), "article_id"), 3).count() == 0


def test_neighbours_leave_out_the_row_itself(spark):
    near = neighbours(frame(spark, clustered_points(30, 4, 8), "article_id"), 2).collect()
    assert len(near) == 60
    assert all(r["article_id"] != r["neighbour_id"] for r in near)


@pytest.mark.parametrize("finish_edges", [0, 20, 1000])
def test_forest_and_components(spark, finish_edges):
    random.seed(5)
    edges = [(f"n{random.randrange(60):02d}", f"n{random.randrange(60):02d}", random.randrange(9) / 3) for _ in range(70)]
    edges += [("hub", f"h{i}", 1.0) for i in range(30)]
    df = spark.createDataFrame(edges, "a string, b string, w double")
    forest, labels = spanning_forest(df, finish_edges)
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    total = 0.0
    for a, b, w in sorted(edges, key=lambda e: e[2]):
        if find(a) != find(b):
            top[find(a)] = find(b)
            total += w
    nodes = {x for a, b, _ in edges if a != b for x in (a, b)}
    expected = {x: min(y for y in nodes if find(y) == find(x)) for x in nodes}
    assert {r["node"]: r["component"] for r in labels.collect()} == expected
    got = forest.collect()
    assert math.isclose(sum(r["w"] for r in got), total)
    assert len(got) == len(nodes) - len(set(expected.values()))
    assert components(df).count() == len(nodes)


def test_lsh_plan():
    for n in (10, 10**4, 10**8):
        for likely in (0.2, 0.6, 0.95):
            bits, tables = plan(n, likely, 0.95)
            same = 1 - math.acos(likely) / math.pi
            assert 1 - (1 - same**bits) ** tables >= 0.95 and tables <= 256
    assert plan(10**8, 0.95, 0.95)[0] > plan(10**4, 0.95, 0.95)[0]


def test_lsh_tables_do_not_grow_with_the_vectors():
    """Every vector is shuffled once a table."""
    assert max(plan(10**e, likely, 0.95)[1] for e in range(1, 10) for likely in (0.2, 0.6, 0.95)) <= 32


def test_blocks_stay_few(spark):
    """However small the blocks that are asked for, a query goes to a few of them, and each holds whole cells or one large cell."""
    rng = np.random.default_rng(5)
    pivots, counts = unit(rng.normal(size=(500, 8))), rng.integers(0, 40, 500)
    counts[7] = 5000
    size = similarity.block_size(int(counts.sum()), 2, 8)
    block_of = similarity.packed(pivots, counts, size)
    held = np.bincount(block_of, weights=counts)
    assert len(held) <= 2 * similarity.MOST_BLOCKS + 2 and [b for b in range(len(held)) if held[b] > size] == [block_of[7]]
    points = clustered_points(400, 6, 9)
    rows = similarity.vectors_only(frame(spark, points), "id")
    cells = np.full(len(pivots), 2.0)
    routed = similarity.route(rows, pivots[:, :6] / np.linalg.norm(pivots[:, :6], axis=1)[:, None], cells, None, block_of)
    assert routed.count() == routed.select("id", "block").distinct().count() <= len(points) * len(held)


def test_scores_closer_than_single_precision_are_told_apart(spark):
    angles = np.array([0.6, 0.6 + 2e-8, 0.6 + 4e-8, 0.9])
    stored = np.stack([np.cos(angles), np.sin(angles)], axis=1)
    top = TopMatches(np.array([[1.0, 0.0]]), 1, None)
    top.add(stored, np.array(list("dcba"), object))
    assert top.table(np.array(["q"], object)).to_pylist() == [{"query_id": "q", "article_id": "d", "score": round(math.cos(0.6), 12)}]


def test_sketches_rule_out_most_pairs_and_no_match():
    """Long vectors are bounded first: the few pairs left hold all matches, also of zero vectors and of directions outside the sample."""
    points = clustered_points(600, 300, 11, centres=80, spread=0.25)
    points[3], points[4, 0] = 0, 50
    rows = np.nan_to_num(unit(points))
    sketch = Sketch(Sketch.directions_of(rows[5:60]))
    (near, far), cos = sketch.of(rows), rows @ rows.T
    bounds = near.astype(float) @ near.T
    lower = bounds - np.outer(near[:, -1], near[:, -1]) + far.astype(float) @ far.T
    assert (cos <= lower + 1e-5).all() and (lower <= bounds + 1e-5).all()
    ids, some = np.array([f"v{i:04d}" for i in range(600)], object), np.arange(100)
    plain, short = TopMatches(rows[:100], 3, 0.9), TopMatches(rows[:100], 3, 0.9, sketch)
    seq = (np.arange(100) % 7, np.arange(600) % 7)
    barred = (some, some)
    left = short._bounded(some, sketch.of(rows), seq, barred)
    assert len(left[0]) < 0.05 * left[2]
    plain.add(rows, ids, seq, barred)
    short.add(rows, ids, seq, barred, None, sketch.of(rows))
    want = plain.table(ids[:100]).sort_by([("query_id", "ascending"), ("article_id", "ascending")]).to_pylist()
    assert want and short.table(ids[:100]).sort_by([("query_id", "ascending"), ("article_id", "ascending")]).to_pylist() == want


@pytest.mark.parametrize("skip_self", [True, False])
def test_long_vectors_in_blocks(spark, skip_self):
    """The join in blocks with sketches and in the order of ``seq`` equals brute force."""
    points = clustered_points(260, 256, 6, centres=60)
    ids = [f"v{i:04d}" for i in range(260)]
    seq = [(i * 37) % 19 for i in range(260)]
    df = frame(spark, points, seq=seq)
    got = {(r.query_id, r.article_id, r["rank"]) for r in top_matches(df, df, 2, 0.95, skip_self, **BLOCKED).collect()}
    assert got == brute_top(points, points, ids, ids, 2, 0.95, lambda i, j: seq[j] < seq[i])


def test_blocks_of_long_vectors_are_few():
    """A long vector is copied once for each block, which costs more than the comparison itself."""
    assert [math.ceil(n / similarity.block_size(n, 4096, 768)) for n in (10**4, 5 * 10**4, 10**5)] == [3, 6, 6]
    assert similarity.block_size(10**9, 4096, 768) * 768 * 4 <= similarity.BLOCK_BYTES


def test_slices_of_the_hierarchy_stay_few():
    assert [cluster.slice_count(n, 150) for n in (0, 150, 300, 1200, 10**5, 4 * 10**6)] == [1, 1, 2, 8, 8, 8]
    assert cluster.slice_count(8 * 10**6, 150) == 16 and cluster.slice_count(8 * 10**6, 10**6) == 8


def test_words_are_counted_in_slices():
    """Counts are made from Arrow arrays a few texts at a time, whatever a batch holds; null and empty texts have none."""
    texts = pa.array([["a", "b", "a"], None, [], ["c"], ["b", "b"]] * 100)
    known = {}
    got = embed._counts(texts.slice(5, 400), 16, known).reshape(400, 16)
    of = embed.buckets(set("abc"), 16)
    want = [np.bincount([of[w] for w in t or []], minlength=16) for t in texts.slice(5, 400).to_pylist()]
    assert (got == np.array(want)).all() and known == of


@pytest.mark.parametrize("name, exact", [("knn_lsh", "knn_topk"), ("cosine_lsh", "cosine_pairs")])
def test_approximate_search_finds_true_matches_and_most_of_them(spark, name, exact):
    sf = "/root/testdata/sf0.01"
    queries.load_all()
    got, want = (queries.QUERIES[q](spark, sf).toPandas() for q in (name, exact))
    key = [c for c in ("query_id", "article_id", "match_id") if c in want.columns]
    found, true = ({tuple(r[:-1]): r[-1] for r in df[[*key, "score"]].itertuples(index=False)} for df in (got, want))
    # the best of those found stands in for a best one that was missed, with its true score
    recall = len(found.keys() & true.keys()) / len(true)
    assert recall >= 0.9, recall
    assert all(abs(found[k] - true[k]) < 1e-9 for k in found.keys() & true.keys())


@pytest.mark.parametrize("block_rows", [4096, 9])
def test_crowded_keys_are_cut(spark, block_rows):
    rng = np.random.default_rng(4)
    stored = (rng.normal(size=(1, 8)) + 0.05 * rng.normal(size=(120, 8))).astype(np.float32)
    df, asked = frame(spark, stored, "article_id"), frame(spark, stored[:30], "query_id")
    exact = {(r.query_id, r.article_id): round(r.score, 9) for r in knn(df, asked, 5).collect()}
    got = {(r.query_id, r.article_id): round(r.score, 9) for r in knn(df, asked, 5, lsh=Lsh(likely=0.9, recall=0.999), block_rows=block_rows).collect()}
    assert len(exact.keys() & got.keys()) >= 0.95 * len(exact)
    with pytest.raises(ValueError):
        knn(df, asked, 5, min_score=None, lsh=Lsh())


def test_stories_are_the_same_in_cells(spark):
    queries.load_all()
    sf = "/root/testdata/sf0.001"
    one, cells = (sorted(map(tuple, queries.QUERIES[q](spark, sf).collect())) for q in ("cluster_stories", "cluster_stories_cells"))
    assert one and one == cells


def test_few_pairs_are_scored_in_double_precision(monkeypatch):
    """With a bound on the distance of the k-th match, and without one after the first rows, few pairs are looked at closely; matches are the same."""
    rng = np.random.default_rng(4)
    rows = unit(rng.normal(size=(5003, 24)))
    rows[40] = rows[7]
    ids, k = np.array([f"v{i:05d}" for i in range(len(rows))], object), 5
    queries, own = rows[:50], (np.arange(50), np.arange(50))
    cos = np.round(queries @ rows.T, 12)
    cos[own] = -np.inf
    want = {(ids[i], ids[j], cos[i, j]) for i in range(50) for j in sorted(range(len(rows)), key=lambda j: (-cos[i, j], ids[j]))[:k]}
    radius = np.sqrt(2 - 2 * np.sort(queries @ rows[50:1050].T, axis=1)[:, -k])
    radius[3] = 2.0
    scored, exact = [], TopMatches._exact
    monkeypatch.setattr(TopMatches, "_exact", lambda self, at, q, *x: (scored.append(len(q)), exact(self, at, q, *x))[1])
    for given in (radius, np.where(radius < 2, radius, 1.99), None):
        scored.clear()
        top = TopMatches(queries, k, None, None, given)
        for at in range(0, len(rows), 1500):
            some = own if at == 0 else (np.empty(0, int), np.empty(0, int))
            top.add(rows[at : at + 1500], ids[at : at + 1500], None, some)
        assert {(r["query_id"], r["article_id"], r["score"]) for r in top.table(ids[:50]).to_pylist()} == want
        assert sum(scored) < 0.01 * cos.size


@pytest.mark.parametrize("crowd", [0, 900])
def test_nearest_outside_in_single_precision_first(crowd):
    """The best edge of each row to another component, also where so many rows are near that all are looked at."""
    rng = np.random.default_rng(crowd)
    rows = unit(np.vstack([rng.normal(size=(2500, 16)), 5 + 0.001 * rng.normal(size=(crowd, 16))]))
    n, core = len(rows), rng.uniform(0, 0.6, len(rows))
    comp, bound, at = rng.integers(0, 6, n), rng.uniform(0.3, 1.2, n), np.arange(0, n, 9)
    far = np.maximum(np.maximum(np.sqrt(np.maximum(2 - 2 * np.round(rows[at] @ rows.T, 12), 0)), core), core[at][:, None])
    far[comp[at][:, None] == comp] = np.inf
    want = np.where(far.min(axis=1) < bound[at], far.min(axis=1), bound[at])
    nearest = reachability._Nearest(rows[at], core[at], comp[at], bound[at])
    for low in range(0, n, 1100):
        nearest.add(np.arange(len(at)), rows[low : low + 1100], core[low : low + 1100], comp[low : low + 1100], low)
    assert np.allclose(nearest.w, want, rtol=0, atol=1e-12)
    hit = nearest.found >= 0
    assert (hit == (want < bound[at])).all() and hit.any()
    assert np.allclose(far[np.flatnonzero(hit), nearest.found[hit]], want[hit], rtol=0, atol=1e-12)


def test_searching_row_goes_once_to_a_block(spark):
    """What a search of the tree shuffles does not grow with the number of cells."""
    points = np.random.default_rng(8).normal(size=(400, 8)).astype(np.float32)
    rows = frame(spark, points, "id").select("id", "embedding", F.lit(0.1).alias("core"))
    cells = reachability.Cells(rows, 400, 4)
    dealt = cells.dealt(rows)
    cells.pack(10)
    assert len(cells.ids) == 100 and cells.block_of.max() < 2 * similarity.STORED_BLOCKS + 2
    looking = dealt.drop("cell").select("*", F.col("id").alias("comp"), F.lit(2.0).alias("bound"))
    routed = reachability._route(looking, cells)
    assert routed.count() == routed.select("id", "block").distinct().count() == 400 * len(set(cells.block_of.tolist()))


@pytest.mark.parametrize("crowded", [False, True])
def test_passes_bound_what_a_block_join_shuffles(spark, monkeypatch, crowded):
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(240, 6)) + (np.array([30, 0, 0, 0, 0, 0]) if crowded else 0)
    df = spark.createDataFrame([(f"v{i:03}", [float(x) for x in v], i) for i, v in enumerate(rows)], "id string, embedding array<float>, seq long")
    shuffled, compare = [], similarity._compare

    def counted(left, right, *rest):
        shuffled.append(left.count() + right.count())
        return compare(left, right, *rest)

    def found():
        shuffled.clear()
        got = similarity.top_matches(df, df, 2, 0.2, max_sent=0, block_rows=16)
        return sorted((r.query_id, r.article_id, round(r.score, 6), r["rank"]) for r in got.collect())

    # blocks of 16 rows or so, so that there are many copies of each side; chunks are dealt by hash, not evenly
    monkeypatch.setattr(similarity, "BLOCK_BYTES", 1)
    monkeypatch.setattr(similarity, "_compare", counted)
    at_once = found()
    copies = shuffled[0]
    monkeypatch.setattr(similarity, "PASS_BYTES", 1, raising=False)
    assert found() == at_once and len(at_once) > 200
    assert copies > 2 * 960 and len(shuffled) > 2 and max(shuffled) <= 1.25 * 960 and sum(shuffled) == copies
