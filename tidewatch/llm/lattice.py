"""Near-duplicate vectors by lattice hashing: random projections, E8 cells, neighbouring cells, exact cosine."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.simhash import forest
from tidewatch.operators.components import connected_components
from tidewatch.session import settle

TABLES = 6
PROBES = 8  # neighbouring cells that a vector asks besides its own
SCALE = 1.4  # length of a projected unit vector's coordinate, in lattice units
SEED = 20
TILE = 512  # rows of a bucket that meet others at once
PAIRS = 20_000


def minimal_vectors() -> np.ndarray:
    """The 240 neighbours of the origin in E8: two coordinates of +-1, or eight of +-1/2 with an even number of minus signs."""
    whole = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            whole.append(v)
    half = [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(whole + half)


def nearest_point(y: np.ndarray) -> np.ndarray:
    """The E8 point next to each row: the nearer one of D8 and of D8 shifted by a half."""
    def d8(x):
        near = np.rint(x)
        odd = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
        off = x[odd] - near[odd]
        worst = np.abs(off).argmax(axis=1)
        near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
        return near

    a, b = d8(y), d8(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1))[:, None], a, b)


def pack_cells(points: np.ndarray) -> np.ndarray:
    """Cells as 64-bit keys: eight doubled coordinates of a byte each."""
    return np.ascontiguousarray((2 * points).astype(np.int64).astype(np.int8)).view(np.int64)[..., 0]


def cells_of(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """(n, tables) own cells and (n, tables, probes) neighbouring cells, nearest first, of unit vectors."""
    roots, own, near = minimal_vectors(), [], []
    half = (roots**2).sum(axis=1) / 2
    for t in range(tables):
        rng = np.random.default_rng([SEED, t, unit.shape[1]])
        y = unit @ (rng.normal(size=(unit.shape[1], 8)) * scale) + rng.uniform(0, 1, 8)
        point = nearest_point(y)
        order = np.argsort(half - (y - point) @ roots.T, axis=1, kind="stable")[:, :probes]
        own.append(pack_cells(point))
        near.append(pack_cells(point[:, None, :] + roots[order]))
    return np.stack(own, axis=1), np.stack(near, axis=1)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            part = batch.slice(start, 1024)
            vectors = part.column(1).to_pylist()
            own: list = [None] * len(vectors)
            near: list = [None] * len(vectors)
            for dims in {len(v) for v in vectors}:
                at = [k for k, v in enumerate(vectors) if len(v) == dims]
                x = np.array([vectors[k] for k in at], np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                a, b = cells_of(x)
                for k, mine, theirs in zip(at, a, b.reshape(len(at), -1)):
                    own[k], near[k] = mine, theirs
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, kind), pa.array(near, kind)], names=["node", "own", "near"])


def first_meeting(t: int, cell: int, own_a, near_a, own_b, near_b) -> np.ndarray:
    """For pairs that meet in bucket ``cell`` of table ``t``: whether they meet in no earlier table, nor in a smaller cell of this one."""
    first = np.ones(len(own_a), bool)
    for s in range(t + 1):
        a, b = own_a[:, s], own_b[:, s]
        same = a == b
        b_asks, a_asks = (near_b[:, s] == a[:, None]).any(axis=1), (near_a[:, s] == b[:, None]).any(axis=1)
        if s < t:
            first &= ~(same | b_asks | a_asks)
        else:
            other = np.where(a == cell, b, a)
            both = ~same & b_asks & a_asks
            first &= ~(both & (other < cell))
    return first


def _compare(least: float):
    def run(table: pa.Table) -> pa.Table:
        head = table.slice(0, 1).to_pylist()[0]
        t, cell, within = head["t"], head["cell"], head["i"] == head["j"]
        node = table.column("node").to_numpy()
        n = table.column("n").to_numpy()
        member = table.column("member").to_numpy().astype(bool)
        chunk = table.column("chunk").to_numpy()
        x = np.array(table.column("vec").to_pylist(), np.float64)
        own = np.array(table.column("own").to_pylist(), np.int64)
        near = np.array(table.column("near").to_pylist(), np.int64).reshape(len(own), own.shape[1], -1)
        x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
        norm = np.sqrt((x * x).sum(axis=1))
        left = np.arange(len(node)) if within else np.flatnonzero(chunk == head["i"])
        right = left if within else np.flatnonzero(chunk == head["j"])
        close = (x[left] @ x[right].T) / (norm[left][:, None] * norm[right][None, :]) >= least
        close &= member[left][:, None] | member[right][None, :]
        if within:
            close = np.triu(close, 1)
        p, q = np.nonzero(close)
        p, q = left[p], right[q]
        links = np.zeros(len(node), np.int64)
        for start in range(0, len(p), PAIRS):
            a, b = p[start:start + PAIRS], q[start:start + PAIRS]
            new = first_meeting(t, cell, own[a], near[a], own[b], near[b])
            np.add.at(links, a[new], n[b[new]])
            np.add.at(links, b[new], n[a[new]])
        tree = np.array(forest(p, q, len(node)), np.int64).reshape(-1, 2)
        some = np.flatnonzero(links)
        return pa.table({
            "u": np.concatenate([node[some], node[tree[:, 0]]]), "v": np.concatenate([np.full(len(some), -1, np.int64), node[tree[:, 1]]]),
            "links": np.concatenate([links[some], np.zeros(len(tree), np.int64)])})

    return run


def near_vectors(vectors: DataFrame, least: float = 0.98, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors of the same label (and length) link at a cosine of ``least`` or
    more, taken in double precision.  n_links counts the other rows that a row
    links with directly, component_id is the smallest vec_id that links reach,
    and kept says whether that is the row's own.

    Candidates share an E8 cell of one of six random projections, or one lies
    in one of the eight cells next to the other's place; every candidate's
    cosine is computed.  Equal vectors are collapsed first and counted.  Cells
    are matched by key alone; only cells that somebody meets in get vectors.
    A bucket is cut into chunks of about 512 rows and pairs of chunks, each a
    task's group, whatever its size; a group returns counts and a spanning
    forest, never pairs.  A pair that meets several times is counted where it
    meets first.

    A null label or vector, a null, infinite or NaN component, and a vector of
    zeros link with nothing: no links, their own component, kept.  Rows with a
    null vec_id link as others do but name no component; other columns are not
    read.
    """
    value = F.col(f"`{vector}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), value.alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("label").isNotNull() & F.col("vec").isNotNull() & ~bad & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("vec", F.when(F.coalesce(usable, F.lit(False)), F.col("vec")))
    distinct = settle(
        rows.filter(F.col("vec").isNotNull()).groupBy("label", "vec").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
        .withColumn("node", F.monotonically_increasing_id()))
    hashed = settle(distinct.select("node", "vec").mapInArrow(_hash, "node long, own array<long>, near array<long>"))
    places = hashed.join(distinct.select("node", F.col("label"), F.size("vec").alias("dims")), "node")
    bucket = ["label", "dims", "t", "cell"]
    members = places.select("node", "label", "dims", F.posexplode("own").alias("t", "cell"))
    asked = places.select("node", "label", "dims", F.posexplode("near").alias("at", "cell")).withColumn("t", (F.col("at") / PROBES).cast("int")).drop("at")
    filled = members.select(*bucket).distinct()
    present = settle(
        members.withColumn("member", F.lit(True)).unionByName(asked.join(filled, bucket, "left_semi").withColumn("member", F.lit(False)).select(*members.columns, "member")))
    sizes = present.groupBy(*bucket).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    chunks = F.ceil(F.col("rows") / TILE).cast("int")
    dealt = present.join(sizes, bucket).withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    tiled = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "node", *bucket, "member", "chunk", F.least("chunk", "with").alias("i"), F.greatest("chunk", "with").alias("j"))
    payload = distinct.select("node", "n", "vec").join(hashed, "node")
    found = settle(
        tiled.join(payload, "node").select("label", "dims", "t", "cell", "i", "j", "node", "n", "member", "chunk", "vec", "own", "near")
        .groupBy("label", "dims", "t", "cell", "i", "j").applyInArrow(_compare(least), "u long, v long, links long"))
    counts = found.filter("v < 0").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    stars = connected_components(found.filter("v >= 0").select(F.lit(0).alias("s"), "u", "v"))
    classes = distinct.join(stars.select(F.col("u").alias("node"), "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    names = classes.groupBy("comp").agg(F.min("least").alias("component_id"))
    answer = classes.join(names, "comp").join(counts, "node", "left").select(
        F.col("label").alias("_label"), F.col("vec").alias("_vec"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    joined = rows.join(answer, (rows["label"] == answer["_label"]) & (rows["vec"] == answer["_vec"]), "left")
    component = F.when(F.col("vec").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
