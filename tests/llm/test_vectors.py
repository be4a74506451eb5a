"""The embedding operators against all pairs on small tables."""

from collections import defaultdict

import numpy as np
import pytest

from shelfline.llm import graph, hilbert, pq_dedup


@pytest.fixture
def vectors(spark):
    def make(rows):
        return spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<float>, node string, times int").repartition(3)

    return make


@pytest.fixture
def odd_vectors(vectors):
    nan, inf = float("nan"), float("inf")
    return vectors(
        [
            (1, [1.0, 0.0, 0.0]),
            (2, [2.0, 0.0, 0.0]),
            (3, [1.0, 0.01, 0.0]),
            (3, [1.0, 0.01, 0.0]),
            (20, [0.0, 0.0, 0.0]),
            (5, None),
            (6, [nan, 1.0, 0.0]),
            (7, [inf, 1.0, 0.0]),
            (8, [1.0, None, 0.0]),
            (9, [1.0]),
            (10, []),
            (None, [0.0, 1.0, 0.0]),
            (40, [0.0, 1.0, 0.0]),
            (60, [-1e30, -1e30, 1e30]),
        ]
    )


def clustered(n, size, seed, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 20, size))
    rows = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, size)) * rng.choice([0.05, 0.2, 1.0], n)[:, None]
    rows[:copies] = rows[0]
    return rows.astype(np.float32)


def brute_links(rows, cosine):
    unit = rows.astype(float) / np.linalg.norm(rows.astype(float), axis=1)[:, None]
    near = unit @ unit.T >= cosine
    np.fill_diagonal(near, False)
    label = np.arange(len(rows))
    while True:
        new = np.array([min(label[i], label[near[i]].min(initial=len(rows))) for i in range(len(rows))])
        if (new == label).all():
            return near, label
        label = new


@pytest.mark.parametrize("members, queries", [(2048, 8192), (7, 11)])
def test_links_and_components(vectors, monkeypatch, members, queries):
    monkeypatch.setattr(pq_dedup, "MEMBERS", members)
    monkeypatch.setattr(pq_dedup, "QUERIES", queries)
    rows = clustered(600, 24, 1, copies=150)
    near, label = brute_links(rows, 0.9)
    got = {r.vec_id: r for r in pq_dedup.near_duplicates(vectors([(i, r.tolist()) for i, r in enumerate(rows)])).collect()}
    found = sum(r.n_links for r in got.values())
    assert 0.9 * near.sum() <= found <= near.sum()
    assert all(got[i].n_links <= near[i].sum() for i in got)
    assert np.mean([got[i].component_id == label[i] for i in got]) >= 0.9
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_all_probes_find_all_links(vectors):
    rows = clustered(300, 16, 2)
    near, label = brute_links(rows, 0.9)
    out = pq_dedup.near_duplicates(vectors([(i, r.tolist()) for i, r in enumerate(rows)]), probes=1000)
    for r in out.collect():
        assert (r.n_links, r.component_id) == (near[r.vec_id].sum(), label[r.vec_id])


@pytest.mark.parametrize("lists", [128, 1024, 4096])
def test_probes_grow_with_the_lists(lists):
    """Pairs at the least cosine, in any direction, are met whatever the number of lists."""
    rng = np.random.default_rng(lists)
    rows, fresh, aside = (pq_dedup.unit(rng.normal(size=(n, 64))) for n in (16 * lists, 4000, 4000))
    coarse = pq_dedup.kmeans(rows, lists, rounds=4)
    probes = pq_dedup.enough_probes(pq_dedup.unit(rng.normal(size=(pq_dedup.TRIAL, 64))), coarse, 0.9)
    aside = pq_dedup.unit(aside - np.einsum("ij,ij->i", aside, fresh)[:, None] * fresh)
    sides = fresh, 0.9 * fresh + np.sqrt(0.19) * aside
    asked = [pq_dedup.nearest(side, coarse, probes) for side in sides]
    met = (asked[0] == asked[1][:, :1]).any(1) | (asked[1] == asked[0][:, :1]).any(1)
    assert met.mean() >= 0.95


def test_odd_vectors_link_with_nothing(odd_vectors):
    out = defaultdict(list)
    for r in pq_dedup.near_duplicates(odd_vectors).collect():
        out[r.vec_id].append((r.n_links, r.component_id, r.kept))
    assert out[1] == [(3, 1, True)] and out[2] == [(3, 1, False)] and out[3] == [(3, 1, False)] * 2
    for i in (20, 5, 6, 7, 8, 9, 10, 60):
        assert out[i] == [(0, i, True)]
    assert out[None] == [(1, 40, False)] and out[40] == [(1, 40, True)]
    assert pq_dedup.near_duplicates(odd_vectors.limit(0)).count() == 0
    assert pq_dedup.near_duplicates(odd_vectors.where("vec_id = 5")).collect()[0].kept


def brute_nearest(ids, rows, k):
    scores = rows.astype(float) @ rows.astype(float).T
    out = {}
    for i, a in enumerate(ids):
        if a % 20 == 0:
            others = [j for j in range(len(ids)) if ids[j] != a]
            out[a] = sorted(others, key=lambda j: (-scores[i, j], ids[j]))[:k]
    return out, scores


def test_small_tables_are_searched_exactly(vectors):
    rows = clustered(400, 12, 3, copies=60)
    want, scores = brute_nearest(list(range(400)), rows, 20)
    got = defaultdict(list)
    for r in sorted(hilbert.search(vectors([(i, r.tolist()) for i, r in enumerate(rows)])).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r.vec_id)
        assert r.rank == len(got[r.query_id]) and r.score == pytest.approx(scores[r.query_id, r.vec_id], rel=1e-12)
    for q in want:
        # ties of equal vectors are exact; other orders may differ in the last bit
        assert len(got[q]) == 20 and np.allclose(sorted(scores[q, got[q]]), sorted(scores[q, want[q]]), rtol=1e-12)
    assert got[0] == want[0] == list(range(1, 21))


def test_ties_go_to_the_smaller_id(vectors):
    rng = np.random.default_rng(6)
    rows = [(i, [1.0, *rng.integers(0, 2, 12).tolist(), float(i)]) for i in range(1, 300)]
    query = (0, [1.0] + [0.0] * 13)
    got = [r for r in hilbert.search(vectors([query, *[(i, [float(x) for x in v]) for i, v in rows]])).collect() if r.query_id == 0]
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)] == list(range(1, 21)) and {r.score for r in got} == {1.0}


@pytest.mark.parametrize("longer, n_long", [(1, 0), (1e3, 1), (1e9, 1), (1e18, 20)])
def test_windows_reach_the_recall(vectors, monkeypatch, longer, n_long):
    monkeypatch.setattr(hilbert, "LEAST_WINDOW", 10)
    monkeypatch.setattr(hilbert, "BLOCK", 100)
    monkeypatch.setattr(hilbert, "LONGEST", 32)
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(2000, 32)).astype(np.float32) * rng.uniform(0.5, 2, (2000, 1)).astype(np.float32)
    rows[7 : 7 + n_long] *= np.float32(longer)
    want, _ = brute_nearest(list(range(2000)), rows, 20)
    got = defaultdict(set)
    for r in hilbert.search(vectors([(i, r.tolist()) for i, r in enumerate(rows)])).collect():
        got[r.query_id].add(r.vec_id)
    assert np.mean([len(got[q] & set(w)) / 20 for q, w in want.items()]) >= 0.9


def test_more_long_vectors_than_stand_beside_the_curves():
    """Equal shares of the vectors in the cells, whatever their lengths."""
    rng = np.random.default_rng(8)
    rows = rng.normal(size=(4000, 24)) * 10.0 ** rng.uniform(-9, 9, (4000, 1))
    projections = hilbert.Projections(24, 4)
    points = projections.points(rows, float(np.sqrt((rows**2).sum(1)).max()))
    borders = np.quantile(points, np.linspace(0, 1, hilbert.BORDERS + 1), axis=0)
    assert all(len(np.unique(key)) > 3000 for key in projections.keys(points, borders))


def test_odd_vectors_take_no_part(odd_vectors):
    out = hilbert.search(odd_vectors).collect()
    assert {r.query_id for r in out} == {40, 60}
    assert [r.vec_id for r in sorted(out, key=lambda r: r.rank) if r.query_id == 40] == [3, 1, 2, 60]
    assert hilbert.search(odd_vectors.limit(0)).count() == 0


def test_hilbert_keys_are_a_curve():
    """Neighbours on the curve are neighbours in space, and every cell has its own key."""
    for d, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
        order = np.argsort(keys := hilbert.hilbert_keys(cells, bits))
        assert sorted(keys) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


def test_components(spark):
    rng = np.random.default_rng(9)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(int(a), int(b)) for a, b in rng.integers(-50, 50, (60, 2))]
    up = {x: x for p in pairs for x in p}

    def top(x):
        return x if up[x] == x else top(up[x])

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: top(x) for p in pairs if p[0] != p[1] for x in p}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
