"""Distance operators against brute force, and invariants of fitted models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import blocks as B
from tidewatch.operators import coreindex as C
from tidewatch.operators import dbscan as D
from tidewatch.operators import lloyd as L
from tidewatch.operators import textmodel as M
from tidewatch.operators.components import connected_components
from tidewatch.operators.forest import average_path, fit_forest, forest_scores
from tidewatch.operators.ranks import percentile_table, running_total
from tidewatch.operators.scoring import anomaly_score, fit_scaler, apply_scaler
from tidewatch.operators.silhouette import silhouette
from tidewatch.operators.windows import volume_features
from tidewatch.plans.features import all_features
from tidewatch.schemas import VOLUME_COLS


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vec array<double>")


def brute(x, eps, need):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    near = d <= eps
    core = near.sum(1) >= need
    label = np.full(len(x), -1)
    c = 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            todo, label[i] = [i], c
            while todo:
                for j in np.nonzero(near[todo.pop()] & core)[0]:
                    if label[j] < 0:
                        label[j] = c
                        todo.append(j)
            c += 1
    for i in np.nonzero(~core)[0]:
        if (near[i] & core).any():
            label[i] = label[near[i] & core].min()
    return label


@pytest.fixture(scope="module")
def mixture():
    rng = np.random.default_rng(7)
    return np.concatenate([rng.normal(0, 0.05, (150, 3)), rng.normal(3, 0.4, (100, 3)), rng.uniform(-3, 6, (80, 3)), np.ones((70, 3))])


@pytest.mark.parametrize("rows", [512, 8])
def test_dbscan_equals_brute_force(spark, mixture, rows):
    settings = [(0.3, 5), (0.6, 10)]
    got = D.dbscan_grid(frame(spark, mixture), settings, "id", "vec", block_rows=rows).collect()
    for i, (eps, need) in enumerate(settings):
        want = brute(mixture, eps, need)
        assert {r.id: r.label for r in got if r.setting == i} == dict(enumerate(want.tolist()))


def test_dbscan_many_partitions(spark, mixture):
    """Range partitions kept apart: the block tree then has several levels."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = D.dbscan_fit(frame(spark, mixture), 0.3, 5, "id", "vec", block_rows=16).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert {r.id: r.label for r in got} == dict(enumerate(brute(mixture, 0.3, 5).tolist()))


def test_dbscan_on_a_lattice_with_exact_ties(spark):
    x = np.round(np.random.default_rng(1).uniform(0, 12, (200, 2)))
    got = D.dbscan_fit(frame(spark, x), 1.0, 4, "id", "vec", block_rows=8).collect()
    assert {r.id: r.label for r in got} == dict(enumerate(brute(x, 1.0, 4).tolist()))


def test_one_hot_point(spark):
    """All rows equal: one weighted row, no pair is ever compared."""
    got = D.dbscan_fit(frame(spark, np.zeros((300, 4))), 0.5, 5, "id", "vec", block_rows=8).collect()
    assert len(got) == 300 and {r.label for r in got} == {0}


def test_fewer_rows_than_min_samples_is_all_noise(spark):
    rows = frame(spark, np.eye(3))
    labels = D.dbscan_fit(rows, 0.1, 5, "id", "vec")
    assert {r.label for r in labels.collect()} == {-1}
    scored = anomaly_score(rows.join(labels, "id"), 3).collect()
    assert {r.anomaly_score for r in scored} == {1.0}


def test_assign_flags_iff_no_core_in_reach(spark, mixture):
    rows = frame(spark, mixture)
    cores = D.core_points(D.dbscan_model(rows, 0.3, 5, "id", "vec"))
    fresh = mixture[::-1] + 0.05
    got = {r.id: r.label for r in C.dbscan_assign(frame(spark, fresh), cores, 0.3, "id", "vec", block_rows=16).collect()}
    label, near = brute(mixture, 0.3, 5), np.sqrt(((mixture[:, None] - mixture[None]) ** 2).sum(-1)) <= 0.3
    core = near.sum(1) >= 5
    for i, x in enumerate(fresh):
        reach = np.sqrt(((mixture - x) ** 2).sum(1)) <= 0.3
        hit = label[reach & core]
        assert got[i] == (hit.min() if len(hit) else -1)


def test_nearest_of_many_centres(spark, mixture):
    asked, known = mixture[:120], mixture[120:]
    centers = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(known)], "label int, center array<double>")
    index = C.build_core_index(centers.withColumnRenamed("center", "vec"), block_rows=8)
    got = {r.id: r.distance for r in C.nearest_cores(frame(spark, asked), index, "id", "vec").collect()}
    want = np.sqrt(((asked[:, None] - known[None]) ** 2).sum(-1)).min(1)
    assert np.allclose([got[i] for i in range(len(asked))], want, atol=1e-7)


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(0, i, i + 1) for i in range(60)] + [(0, 100 + i, 200) for i in range(40)] + [(1, int(a), int(b)) for a, b in rng.integers(0, 80, (50, 2))]
    got = connected_components(spark.createDataFrame(edges, "s int, u long, v long")).collect()
    for s in (0, 1):
        parent = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for t, u, v in edges:
            if t == s and u != v:
                a, b = find(u), find(v)
                parent[max(a, b)] = min(a, b)
        assert {r.u: r.comp for r in got if r.s == s} == {u: find(u) for u in parent}


def test_running_total_and_percentiles(spark):
    values = np.random.default_rng(5).integers(0, 500, 4000).astype(float)
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(7)
    row = percentile_table(df, "v", {"a": 0.0, "b": 0.25, "c": 0.95, "d": 0.999, "e": 1.0}).first()
    assert np.allclose(list(row), np.quantile(values, [0, 0.25, 0.95, 0.999, 1.0]))
    ids = running_total(spark.range(1000), ["id"]).orderBy("id").collect()
    assert [r.upto for r in ids] == list(range(1, 1001))


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert [tuple(r) for r in apply_scaler(df, fit_scaler(df, ["a", "b"])).orderBy("a").collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_silhouette_of_separate_clusters(spark):
    x = np.concatenate([np.random.default_rng(0).normal(0, 0.01, (20, 2)), np.random.default_rng(1).normal(9, 0.01, (20, 2))])
    df = frame(spark, x).withColumn("label", (F.col("id") >= 20).cast("int"))
    assert silhouette(df, "id", "vec", "label").first().silhouette > 0.99


def test_forest_is_repeatable_and_ranks_outliers(spark):
    x = np.concatenate([np.random.default_rng(0).normal(0, 1, (300, 2)), [[12.0, 12.0], [-15.0, 9.0]]])
    rows = frame(spark, x)
    run = lambda: {r.id: r.s for r in rows.select("id", forest_scores("vec", fit_forest(rows, "id", "vec", trees=50))[0].alias("s")).collect()}
    first = run()
    assert first == run()
    assert set(sorted(first, key=first.get)[:2]) == {300, 301}
    assert all(-1 <= s < 0 for s in first.values()) and average_path(2) == 1.0


@pytest.fixture(scope="module")
def text_model(spark, sf):
    from tidewatch.sources.logs import read_events

    return M.fit_text_model(read_events(spark, sf), k=8, restarts=2)


def test_text_model_invariants(spark, logs, text_model):
    rank = min(len(text_model.terms), text_model.basis.shape[1])
    v = text_model.basis[:, :rank]
    assert np.allclose(v.T @ v, np.eye(rank), atol=1e-9)
    assert 0.0 < text_model.explained <= 1.0 + 1e-9
    counts = M.template_counts(logs)
    rows = counts.select("count", M.tokenize_ngrams("template").alias("t")).collect()
    index = {t: i for i, t in enumerate(text_model.terms)}
    x = np.zeros((len(rows), len(index)))
    for i, r in enumerate(rows):
        for t in r.t:
            if t in index:
                x[i, index[t]] += text_model.idf[index[t]]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    full = np.repeat(x, [r["count"] for r in rows], axis=0)
    values = np.linalg.svd(full, compute_uv=False)[:rank]
    assert np.allclose(np.linalg.norm(full @ v, axis=0), values, atol=1e-6)
    var = lambda m: ((m - m.mean(0)) ** 2).mean(0).sum()
    assert np.isclose(text_model.explained, var(full @ v) / var(full))


def test_all_features_volume_part(spark, logs, text_model):
    got = all_features(logs, text_model, "1 hour")
    want = volume_features(logs, "1 hour")
    assert got.count() == want.count()
    assert got.select("timestamp", *VOLUME_COLS).exceptAll(want.select("timestamp", *VOLUME_COLS)).count() == 0
    assert got.filter((F.col("message_anomaly_score") < 0) | (F.col("message_anomaly_score") > 1)).count() == 0


def test_labels_do_not_depend_on_row_order(spark, mixture):
    rows = frame(spark, mixture)
    pick = lambda df: {r.id: r.label for r in D.dbscan_fit(df, 0.3, 5, "id", "vec", block_rows=64).collect()}
    assert pick(rows) == pick(rows.orderBy(F.rand(1)).repartition(5))


def test_scores_lie_in_unit_interval(spark, mixture):
    rows = frame(spark, mixture)
    scored = anomaly_score(rows.join(D.dbscan_fit(rows, 0.3, 5, "id", "vec"), "id"), 3).collect()
    assert all(0 <= r.anomaly_score <= 1 for r in scored) and max(r.anomaly_score for r in scored) == 1.0


# ---- blocks, bounds and the stored core index ------------------------------------------------

def thin(seed, n, dims=30, rank=3):
    """Vectors that fill few directions of their space, none of them an axis."""
    rng = np.random.default_rng(seed)
    return rng.normal(0, 1, (n, rank)) @ rng.normal(0, 1, (rank, dims)) + rng.normal(0, 0.01, (n, dims)) + 5


def space_of(spark, x, rows):
    points = frame(spark, x).withColumns({"weight": F.lit(1).cast("long"), "tag": F.lit(-1).cast("long")})
    return B.build_blocks(points, rows)


def box_table(space):
    both = space.packed.select("block", "mat", *B.BOUNDS)
    pairs = B.sides(both, "a").join(B.sides(both, "b"), F.col("block_a") <= F.col("block_b"))
    rows = pairs.select("block_a", "block_b", "mat_a", "mat_b", B.box_gap2().alias("gap2"), B.box_reach2().alias("reach2")).collect()
    mat = lambda m: np.frombuffer(m).reshape(-1, space.dims)
    return [(r, mat(r.mat_a), mat(r.mat_b)) for r in rows]


@pytest.mark.parametrize("kind", ["thin", "lattice", "offset"])
def test_bounds_hold_every_row_pair(spark, kind):
    x = {"thin": thin(1, 300), "lattice": np.round(np.random.default_rng(2).uniform(0, 6, (300, 3))), "offset": np.random.default_rng(3).normal(1e7, 1, (300, 4))}[kind]
    for r, a, b in box_table(space_of(spark, x, 16)):
        d2 = ((a[:, None] - b[None]) ** 2).sum(2)
        assert r.gap2 <= d2.min() and d2.max() <= r.reach2


def test_principal_axes_leave_fewer_pairs(spark):
    """On vectors of few directions the frame's boxes and pivots decide pairs that boxes on the given axes cannot."""
    table = box_table(space_of(spark, thin(4, 1500), 16))
    eps2, plain, kept, real = 4.0, 0, 0, 0
    for r, a, b in table:
        side = np.maximum(np.maximum(a.min(0) - b.max(0), b.min(0) - a.max(0)), 0)
        plain += (side ** 2).sum() <= eps2
        kept += r.gap2 <= eps2
        real += ((a[:, None] - b[None]) ** 2).sum(2).min() <= eps2
    assert real <= kept < 0.9 * plain < len(table)


def test_blocks_travel_once_per_tile(spark):
    pairs = spark.createDataFrame([(a, b) for a in range(64) for b in range(a, 64)], "a long, b long")
    dealt, wanted = B.deal_tiles(pairs)
    assert dealt.count() == 64 * 65 // 2 and dealt.select("ta", "tb").distinct().count() == 36
    assert wanted.count() == 8 * 8 + 28 * 16  # 8 tiles on the diagonal, 28 beside it


def test_travels_of_a_block_do_not_grow_with_the_blocks(spark):
    travels = lambda bits: B.deal_tiles(spark.range(1 << bits).select(F.col("id").alias("a")).join(
        spark.range(1 << bits).select(F.col("id").alias("b")), F.expr("a <= b")), B.tile_width(bits, 4))[1].count() / (1 << bits)
    assert travels(9) == travels(10) <= 33


def test_small_blocks_are_compared_as_nodes(spark):
    space = space_of(spark, np.random.default_rng(11).normal(0, 1, (700, 3)), 32)
    assert space.floor == 1
    assert {r.level for r in B.block_pairs(space, -1.0, 0.5).collect()} == {1}


@pytest.mark.parametrize("kind, share", [("clusters", 1.0), ("one cloud", 0.9)])
def test_settled_rows_are_not_compared_again(spark, monkeypatch, kind, share):
    """Turns give the labels of brute force; later ones leave out pairs of nodes that have nothing to add."""
    rng = np.random.default_rng(4)
    if kind == "clusters":
        x = np.concatenate([rng.uniform(0, 6, (1400, 2)), rng.normal((15, 3), 0.4, (400, 2)), rng.uniform(-4, 20, (60, 2)), np.full((40, 2), 3.0)])
        settings = [(0.35, 4), (0.5, 12)]
    else:
        x, settings = rng.uniform(0, 4, (1920, 4)), [(1.8, 4), (2.0, 8)]
    pairs, plain = [], B.compare_rows

    def counting(space, todo, *args, **options):
        pairs.append(todo.count())
        return plain(space, todo, *args, **options)

    monkeypatch.setattr(D, "compare_rows", counting)

    def labels():
        pairs.clear()
        got = D.dbscan_grid(frame(spark, x), settings, "id", "vec", block_rows=64).collect()
        for i, (eps, need) in enumerate(settings):
            assert {r.id: r.label for r in got if r.setting == i} == dict(enumerate(brute(x, eps, need).tolist()))
        return sum(pairs)

    at_once = labels()
    monkeypatch.setattr(B, "TURNS_FROM", 1)
    monkeypatch.setattr(B, "TURNS", (16, 4))
    assert labels() < share * at_once and len(pairs) > 2


def brute_contact(fresh, cores, labels, eps):
    d = np.sqrt(((fresh[:, None] - cores[None]) ** 2).sum(2)) <= eps
    return [int(labels[row].min()) if row.any() else -1 for row in d]


@pytest.mark.parametrize("rows", [4, 64])
def test_core_index_equals_brute_force(spark, tmp_path, rows):
    cores, labels = np.concatenate([thin(5, 200), thin(5, 50)]), np.arange(250) % 7
    fresh = np.concatenate([thin(5, 120) + 0.05, np.zeros((3, 30)), thin(5, 40)])
    known = spark.createDataFrame([([float(v) for v in c], int(n)) for c, n in zip(cores, labels)], "vec array<double>, label int")
    index = C.build_core_index(known, f"file://{tmp_path}/index", rows)
    copied = C.copy_core_index(spark, C.open_core_index(spark, index.path), f"file://{tmp_path}/copy")
    for eps in (0.4, 3.0, 1000.0):
        got = {r.id: r.label for r in C.probe_cores(frame(spark, fresh), C.open_core_index(spark, copied.path), eps, "id", "vec").collect()}
        assert got == dict(enumerate(brute_contact(fresh, cores, labels, eps)))


def test_core_index_without_cores(spark):
    none = spark.createDataFrame([], "vec array<double>, label int")
    index = C.build_core_index(none)
    assert [r.label for r in C.probe_cores(frame(spark, np.zeros((3, 2))), C.open_core_index(spark, index.path), 1.0, "id", "vec").collect()] == [-1] * 3
    some = C.build_core_index(spark.createDataFrame([([0.0, 0.0], 3)], "vec array<double>, label int"))
    assert C.probe_cores(frame(spark, np.zeros((0, 2))), some, 1.0, "id", "vec").count() == 0


def test_probing_does_not_grow_with_stored_cores(spark):
    """Ten times the cores, the new ones elsewhere: the walk meets as many nodes and opens as many shelves."""
    rng = np.random.default_rng(8)
    spots = rng.uniform(-1000, 1000, (100, 6))
    fresh = frame(spark, spots[:3].repeat(16, 0) + rng.normal(0, 0.1, (48, 6)))
    met = []
    for many in (10, 100):
        cores = (spots[:many].repeat(60, 0) + rng.normal(0, 0.1, (60 * many, 6))).tolist()
        index = C.build_core_index(spark.createDataFrame([(c, 0) for c in cores], "vec array<double>, label int"), block_rows=8)
        asked = B.pack_blocks(fresh.withColumns({"weight": F.lit(1).cast("long"), "tag": F.lit(-1).cast("long")}), 8, index.frame)
        asked = asked.withColumn("block", F.shiftleft("part", 32).bitwiseOR(F.col("seq")))
        near = C.near_shelves(asked, index, 1.0)
        shelves = spark.read.parquet(f"{index.path}/shelves").select("shelf").distinct().count()
        met.append((near.select("node").distinct().count(), shelves))
    assert met[1][1] > 5 * met[0][1] and met[1][0] <= 2 * met[0][0] and met[1][0] < 0.2 * met[1][1]


def brute_lloyd(x, w, centers, rounds, shift):
    for _ in range(rounds):
        near = ((x[:, None] - centers[None]) ** 2).sum(2).argmin(1)
        moved = np.array([np.average(x[near == c], axis=0, weights=w[near == c]) if (near == c).any() else centers[c] for c in range(len(centers))])
        step, centers = np.sqrt(((moved - centers) ** 2).sum(1)).max(), moved
        if step <= shift:
            break
    return centers, (w * ((x[:, None] - centers[None]) ** 2).sum(2).min(1)).sum()


def test_all_restarts_equal_brute_force(spark):
    """Runs share their passes; each ends where it would have ended alone, and the cheapest wins."""
    rng = np.random.default_rng(11)
    x, w = np.concatenate([rng.normal(c, 0.3, (40, 4)) for c in range(5)]), rng.integers(1, 9, 200).astype(float)
    points = spark.createDataFrame([([float(v) for v in row], float(n)) for row, n in zip(x, w)], "vec array<double>, n double")
    data = L.prepare(points, weight="n")
    starts = L.spread_centers(data, 5, 3, 4)
    assert starts.shape == (4, 5, 4) and all(np.isclose(x[:, None], c[None]).all(2).any(0).all() for c in starts)
    assert np.array_equal(starts, L.spread_centers(data, 5, 3, 4)) and not np.array_equal(starts[0], starts[1])
    centers, costs = L.lloyd(data, starts)
    for start, got, cost in zip(starts, centers, costs):
        want, price = brute_lloyd(x, w, start, L.ROUNDS, L.SHIFT)
        assert np.allclose(got, want) and np.isclose(cost, price)
    best = L.best_of(points, 5, 3, 4, weight="n")
    assert np.isclose((w * ((x[:, None] - best[None]) ** 2).sum(2).min(1)).sum(), costs.min())


def test_more_centres_than_rows(spark):
    points = spark.createDataFrame([([0.0, 1.0],), ([0.0, 1.0],), ([2.0, 1.0],)], "vec array<double>")
    assert {tuple(c) for c in L.best_of(points, 5, 1, 2).tolist()} == {(0.0, 1.0), (2.0, 1.0)}
