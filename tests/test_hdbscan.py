"""HDBSCAN against a direct top-down construction in numpy."""

import numpy as np
import pytest

from tidewatch.operators import hdbscan as H
from tidewatch.operators.blocks import build_blocks
from tidewatch.operators.dbscan import collapse_copies
from tidewatch.session import settle


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vec array<double>")


def cores_of(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    return d, np.sort(d + np.diag(np.full(len(x), np.inf)), axis=1)[:, min(k, len(x) - 1) - 1]


def tree_of(x, k):
    """Kruskal over all pairs, ordered by (weight, lo, hi)."""
    d, core = cores_of(x, k)
    mr = np.maximum(np.maximum(d, core[:, None]), core[None, :])
    i, j = np.triu_indices(len(x), 1)
    edges = sorted(zip(mr[i, j], i, j))
    parent = list(range(len(x)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    kept = []
    for w, a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[ra] = rb
            kept.append((w, a, b))
    return kept


def top_down(n, edges, m):
    """Split recursively at the heaviest edge; excess of mass picks the clusters."""
    label = np.full(n, -1)

    def parts(nodes, inner):
        parent = {v: v for v in nodes}

        def find(a):
            while parent[a] != a:
                a = parent[a]
            return a

        for _, a, b in inner:
            parent[find(a)] = find(b)
        return find

    def walk(nodes, inner, birth, root):
        """-> (score, list of clusters) of the cluster ``nodes``."""
        own, members, inner = 0.0, set(nodes), sorted(inner)
        everyone = set(nodes)
        while True:
            if not inner:
                return (own, [] if root else [everyone])
            w, a, b = inner.pop()
            lam = 1.0 / w
            find = parts(members, inner)
            left = {v for v in members if find(v) == find(a)}
            right = members - left
            big = [s for s in (left, right) if len(s) >= m]
            if len(big) == 2:
                own += len(members) * (lam - birth)
                subs = [walk(s, [e for e in inner if e[1] in s], lam, False) for s in big]
                below = sum(s for s, _ in subs)
                if own >= below and not root:
                    return own, [everyone]
                return below, [c for _, cs in subs for c in cs]
            fallen = members if not big else members - big[0]
            own += len(fallen) * (lam - birth)
            if not big:
                return own, [] if root else [everyone]
            members, inner = big[0], [e for e in inner if e[1] in big[0]]

    _, clusters = walk(set(range(n)), edges, 0.0, True)
    for number, c in enumerate(sorted(clusters, key=min)):
        label[list(c)] = number
    return label


@pytest.fixture(scope="module")
def x():
    rng = np.random.default_rng(11)
    return np.concatenate([rng.normal(0, 0.3, (60, 2)), rng.normal(4, 0.5, (50, 2)), rng.normal((0, 6), 0.15, (40, 2)), rng.uniform(-3, 9, (30, 2))])


@pytest.mark.parametrize("rows", [512, 16])
def test_core_distances_and_tree(spark, x, rows):
    space = build_blocks(settle(collapse_copies(frame(spark, x), "id", "vec")), rows)
    cores = settle(H.core_distances(space, [3, 7]))
    got = {r.id: r.core for r in cores.collect()}
    for at, k in enumerate((3, 7)):
        assert np.allclose([got[i][at] for i in range(len(x))], cores_of(x, k)[1], atol=1e-7)
    edges = H.spanning_tree(space, cores, 0).collect()
    want = tree_of(x, 3)
    assert len(edges) == len(x) - 1
    assert np.isclose(sum(e.w for e in edges), sum(e[0] for e in want))


def test_labels(spark, x):
    settings = [(5, 3), (12, 3)]
    got = H.hdbscan_grid(frame(spark, x), settings, "id", "vec").collect()
    for s, (m, k) in enumerate(settings):
        want = top_down(len(x), tree_of(x, k), m)
        assert {r.id: r.label for r in got if r.setting == s} == dict(enumerate(want.tolist()))
        assert want.max() >= 1


def test_fall_out_in_rounds_equals_replay(spark, x):
    x = x[::2]
    core = cores_of(x, 2)[1]
    tree = settle(spark.createDataFrame([(float(w), int(a), int(b)) for w, a, b in tree_of(x, 2)], "w double, lo long, hi long"))
    members = settle(spark.createDataFrame([(i, 1, float(c)) for i, c in enumerate(core)], "id long, weight long, core double"))
    run = lambda limit: {r.id: r.t for r in H.fall_out(tree, members, 3, replay_limit=limit).collect()}
    assert run(0) == run(10**6)


def test_copies_count_with_their_number(spark):
    x = np.concatenate([np.zeros((20, 2)), np.full((20, 2), 5.0), [[50.0, 50.0]]])
    got = {r.id: r.label for r in H.hdbscan(frame(spark, x), 5, 3, "id", "vec").collect()}
    assert got == {**{i: 0 for i in range(20)}, **{i: 1 for i in range(20, 40)}, 40: -1}


def test_too_few_rows(spark):
    assert {r.label for r in H.hdbscan(frame(spark, np.eye(4)), 10, 2, "id", "vec").collect()} == {-1}


def test_core_distances_travel_in_tiles(spark, x):
    """A block goes to a tile once and not to every pair; copies count with their number."""
    x = np.concatenate([x, x[:30], x[:10]])
    space = build_blocks(settle(collapse_copies(frame(spark, x), "id", "vec")), 8)
    cores = H.core_distances(space, [4])
    assert "FlatMapCoGroupsInPandas" in cores._jdf.queryExecution().executedPlan().toString()
    want = cores_of(x, 4)[1]
    got = {r.id: r.core[0] for r in cores.collect()}
    assert len(got) == 180 and all(np.isclose(c, want[i], atol=1e-7) for i, c in got.items())


def test_core_distance_query_returns_every_copy(spark, x, tmp_path):
    """Each row has its distance, also rows that share their vector; five rows have no fifth other one."""
    from tidewatch.catalog.base import QUERIES

    def run(rows, name):
        table = [(i, [float(v) for v in row], 0) for i, row in enumerate(rows)]
        spark.createDataFrame(table, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        return QUERIES["hdbscan_core_distance"](spark, f"{tmp_path}/{name}").collect()

    x = np.concatenate([x, x[:30], x[:10], np.repeat(x[40:41], 6, axis=0)])
    got, want = run(x, "copies"), cores_of(x, 5)[1]
    assert sorted(r.id for r in got) == list(range(len(x)))
    assert all(np.isclose(r.core_distance, want[r.id], atol=1e-6) for r in got)
    assert len(run(x[:6], "six")) == 6 and not run(x[:5], "five")


@pytest.mark.parametrize("once", [0, 10**9])
def test_tree_in_rounds_and_at_once(spark, x, once, monkeypatch):
    """Rounds over pruned pairs and one pass over all pairs give the one tree of the order (w, lo, hi)."""
    monkeypatch.setattr(H, "ONCE", once)
    x = np.concatenate([x, np.random.default_rng(5).uniform(-3, 9, (700, 2))])
    space = build_blocks(settle(collapse_copies(frame(spark, x), "id", "vec")), 16)
    edges = H.spanning_tree(space, settle(H.core_distances(space, [3])), 0).collect()
    assert sorted((e.lo, e.hi) for e in edges) == sorted(e[1:] for e in tree_of(x, 3))


@pytest.mark.parametrize("kind", ["mixture", "far clusters", "lattice"])
def test_tree_from_listed_rows(spark, x, kind):
    """Lists that hold no edge between clusters, or equal distances only, give the tree of all pairs."""
    rng = np.random.default_rng(5)
    if kind == "mixture":
        x = np.concatenate([x, rng.uniform(-3, 9, (500, 2))])
    elif kind == "far clusters":
        x = np.concatenate([rng.normal(c, 0.2, (120, 3)) for c in ((0, 0, 0), (9, 0, 0), (0, 9, 1), (9, 9, 5))])
    else:
        x = np.unique(np.round(rng.uniform(0, 14, (300, 2))), axis=0)
    space = build_blocks(settle(collapse_copies(frame(spark, x), "id", "vec")), 64)
    cores = settle(H.core_distances(space, [3], 5))
    edges = H.tree_from_lists(space, cores).collect()
    want = tree_of(x, 3)
    assert len(edges) == len(x) - 1 and np.allclose(sorted(e.w for e in edges), sorted(e[0] for e in want), atol=1e-7)
    if kind != "lattice":
        assert sorted((e.lo, e.hi) for e in edges) == sorted(e[1:] for e in want)


def test_core_distances_in_turns(spark, x, monkeypatch):
    from tidewatch.operators import blocks as B

    monkeypatch.setattr(B, "TURNS_FROM", 1)
    monkeypatch.setattr(B, "TURNS", (8, 4))
    space = build_blocks(settle(collapse_copies(frame(spark, x), "id", "vec")), 64)
    got = {r.id: r for r in H.core_distances(space, [4], 6).collect()}
    assert np.allclose([got[i].core[0] for i in range(len(x))], cores_of(x, 4)[1], atol=1e-7)
    d = cores_of(x, 4)[0]
    assert all({n.id for n in got[i].near} == set(np.argsort(d[i] + (np.arange(len(x)) == i) * 1e9)[:6].tolist()) for i in range(len(x)))


def test_forest_of_a_table_in_rounds(spark):
    rng = np.random.default_rng(2)
    pairs = {tuple(sorted(p)) for p in rng.integers(0, 60, (500, 2)).tolist() if p[0] != p[1]}
    rows = [(float(rng.integers(0, 5)), u, v, u, v) for u, v in pairs]  # many equal weights
    table = spark.createDataFrame(rows, "w double, lo long, hi long, u long, v long")
    want = sorted(tuple(r) for r in H.spanning_forest(table).collect())
    assert want == sorted(tuple(r) for r in H.spanning_forest(table, replay_limit=0).collect()) and len(want) == 59
    assert sum(r[0] for r in want) == min_weight(rows, 60)


def min_weight(rows, n):
    parent, total = list(range(n)), 0.0

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for w, lo, hi, *_ in sorted(rows):
        if find(lo) != find(hi):
            parent[find(lo)] = find(hi)
            total += w
    return total
