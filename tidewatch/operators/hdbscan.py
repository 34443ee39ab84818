"""Hierarchical density clustering (HDBSCAN).

1. core distances: k nearest rows through the block tree;
2. minimum spanning tree of mutual reachability: the lightest forest over the
   nearest rows, and what it leaves open is searched for; or Boruvka rounds, each
   a pruned walk over the block tree, or one pass over all pairs where bounds prune little;
3. fall-out height of every row, cluster tree, stability and labels.

The rows stay distributed throughout; only the cluster tree itself (at most
rows / min_cluster_size nodes, usually a handful) is handled in one place.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.blocks import (
    BLOCK_ROWS, FAN_BITS, BlockSpace, box_gap2, box_reach2, build_blocks, compare_rows, descend, in_turns, roll_up, verdict)
from tidewatch.operators.components import connected_components
from tidewatch.operators.dbscan import FLUSH_LINKS, collapse_copies, number_groups, to_every_row
from tidewatch.operators.kernels import longs, matrix, sq_distances
from tidewatch.session import settle

BIG = np.iinfo(np.int64).max
EDGE = "w double, lo long, hi long"

PAYLOAD = ["mat", "ids", "core", "comp"]

REPLAY = 2_000_000
NEAREST = 8  # rows whose distances are kept for the spanning tree
ONCE = 8  # about the rounds that a tree takes


# ---- 1. core distances -------------------------------------------------------------------------

def _kth(d: np.ndarray, w: np.ndarray, own: int, k: int) -> float:
    """k-th nearest other row, copies counted: ``own`` - 1 of them lie at distance 0."""
    if own - 1 >= k:
        return 0.0
    order = np.argsort(d, kind="stable")
    seen = np.cumsum(w[order]) + own - 1
    at = int(np.searchsorted(seen, k))
    return float(d[order][min(at, len(order) - 1)]) if len(order) else 0.0


def core_distances(space: BlockSpace, ks: Sequence[int], listed: int = 0) -> DataFrame:
    """(block, row, id, weight, core array<double>): distance to the k-th nearest other row, per k.

    With ``listed`` also ``near``, at least so many of the nearest distinct
    vectors as (id, d), and ``depth``, a distance that no other one is closer than.
    """
    ks, dims, block_rows = list(ks), space.dims, space.block_rows
    most = max(*ks, listed)
    rows = space.packed.select("block", "mat", "weights", "ids")

    def own_reach(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                m = matrix(r.mat, dims)
                d2 = sq_distances(m, m)
                out.append(float(np.sqrt(np.partition(d2, most, axis=1)[:, most].max())) if len(m) > most else float("inf"))
            yield pd.DataFrame({"block": pdf["block"], "search": out})

    def judge(cand, level):
        radius = F.greatest("search_a", "search_b")
        return verdict(cand.filter(box_gap2() <= radius * radius), level, F.lit(False))

    reach = rows.mapInPandas(own_reach, "block long, search double")
    pairs = descend(roll_up(reach, space, [F.max("search").alias("search")]), judge, space.floor)

    def nearest(frames):
        held: dict[int, dict] = {}

        def merge(h):
            """What has been found since goes to the nearest of each row; ``upto`` says what the next one must be below."""
            n = len(h["best"])
            row, d, w, who = (np.concatenate([old.ravel(), *new]) for old, new in zip(
                (np.repeat(np.arange(n), most), h["best"], h["w"], h["who"]), zip(*h["new"])))
            order = np.lexsort((d, row))
            take = order[np.searchsorted(row[order], np.arange(n))[:, None] + np.arange(most)]
            h.update(best=d[take], w=w[take], who=who[take], new=[], size=0)
            h["upto"] = np.minimum(h["best"][:, -1], h["reach"])

        def add(node, at, d2, turned, weights, ids, reach):
            n = d2.shape[1 if turned else 0]
            if node not in held:
                held[node] = h = {"at": longs(at), "best": np.full((n, most), np.inf), "w": np.zeros((n, most), np.int64), "who": np.zeros((n, most), np.int64),
                                  "new": [], "size": 0, "reach": reach, "upto": np.minimum(np.full(n, np.inf), reach)}
                if np.isinf(h["upto"]).all():
                    d = d2.T if turned else d2
                    near = np.argpartition(d, min(most, d.shape[1]) - 1, axis=1)[:, :most]
                    i, j = np.repeat(np.arange(n), near.shape[1]), near.ravel()
                    h["new"].append((i, d[i, j], weights[j], ids[j]))
                    return merge(h)
            h = held[node]
            if turned:
                j, i = np.nonzero(d2 < h["upto"][None, :])
                d = d2[j, i]
            else:
                i, j = np.nonzero(d2 < h["upto"][:, None])
                d = d2[i, j]
            if len(i):
                h["new"].append((i, d, weights[j], ids[j]))
                h["size"] += len(i)
                if h["size"] > n * most:
                    merge(h)

        for pdf in frames:
            known = "reach_a" in pdf.columns
            for r in pdf.itertuples(index=False):
                d2 = sq_distances(matrix(r.mat_a, dims), matrix(r.mat_b, dims))
                if r.a == r.b:
                    np.fill_diagonal(d2, np.inf)
                add(r.a, r.at_a, d2, False, longs(r.weights_b), longs(r.ids_b), matrix(r.reach_a, 1)[:, 0] if known else np.inf)
                if r.a != r.b:
                    add(r.b, r.at_b, d2, True, longs(r.weights_a), longs(r.ids_a), matrix(r.reach_b, 1)[:, 0] if known else np.inf)
        for h in held.values():
            if h["new"]:
                merge(h)
            some = np.isfinite(h["best"]).any(1)
            at, best, w, who = (h[c][some] for c in ("at", "best", "w", "who"))
            yield pd.DataFrame({"block": at // block_rows, "row": (at % block_rows).astype(np.int32), "d": list(best), "w": list(w), "who": list(who)})

    def as_bytes(frames):
        for pdf in frames:
            yield pdf.assign(reach=[np.asarray(x, dtype=np.float64).tobytes() for x in pdf["reach"]])

    first, *rest = in_turns(space, pairs)
    schema = "block long, row int, d array<double>, w array<long>, who array<long>"
    cols = ["mat", "weights", "ids"]
    found = compare_rows(space, first, space.packed, cols, nearest, schema, tile_bits=space.wide_bits)
    if rest:  # a row's last listed distance bounds what the others can add
        found = settle(found)
        last = found.groupBy("block", "row").agg(F.array_sort(F.flatten(F.collect_list("d")))[most - 1].alias("reach"))
        inf = F.array_repeat(F.lit(float("inf")), F.col("n"))
        last = last.groupBy("block").agg(F.collect_list(F.struct("row", "reach")).alias("r"))  # one block per group
        by_row = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.element_at(F.map_from_entries("r"), i))
        payload = settle(space.packed.select("block", "n", *cols).join(last, "block", "left").select(
            "block", "n", *cols, F.when(F.col("r").isNull(), inf).otherwise(F.transform(by_row, lambda x: F.coalesce(x, F.lit(float("inf"))))).alias("reach"))
            .mapInPandas(as_bytes, "block long, n int, mat binary, weights binary, ids binary, reach binary"))
        later = rest[0]
        for turn in rest[1:]:
            later = later.unionByName(turn)
        found = found.unionByName(compare_rows(space, later, payload, [*cols, "reach"], nearest, schema, tile_bits=space.wide_bits))
    # At most (tiles that hold the block) x k values per row.
    merged = found.groupBy("block", "row").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("d", "w", "who")])

    def unpack(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                ids, w = longs(r.ids), longs(r.weights)
                yield pd.DataFrame({"block": r.block, "row": np.arange(len(ids), dtype=np.int32), "id": ids, "weight": w, "norm2": (matrix(r.mat, dims) ** 2).sum(1)})

    named = rows.mapInPandas(unpack, "block long, row int, id long, weight long, norm2 double")

    def finish(frames):
        for pdf in frames:
            cores, near, depth = [], [], []
            for d2, w, who, own, norm2 in zip(pdf["d"], pdf["w"], pdf["who"], pdf["weight"], pdf["norm2"]):
                d2, w, who = (np.asarray(x if x is not None else []) for x in (d2, w, who))
                real = np.isfinite(d2)
                d2, w, who = d2[real], w[real], who[real]
                order = np.lexsort((who, d2))[:most]
                d = np.sqrt(d2[order])
                cores.append([_kth(d, w[order], int(own), k) for k in ks])
                near.append([{"id": int(i), "d": float(x)} for i, x in zip(who[order], d)])
                # Sums of products round: the next one may be that much closer.
                room = 1e-9 * (norm2 + (np.sqrt(norm2) + d[-1]) ** 2) if len(d) else 0.0
                depth.append(float(np.sqrt(max(d2[order][-1] - room, 0.0))) if len(d) == most else float("inf"))
            out = pdf[["block", "row", "id", "weight"]].assign(core=cores)
            yield out.assign(near=near, depth=depth) if listed else out

    more = ", near array<struct<id: long, d: double>>, depth double" if listed else ""
    return named.join(merged, ["block", "row"], "left").select("block", "row", "id", "weight", "norm2", "d", "w", "who").mapInPandas(
        finish, "block long, row int, id long, weight long, core array<double>" + more)


def core_distance(points: DataFrame, k: int, id_col: str, vec_col: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, core_distance) of every row: the distance to its k-th nearest other row; nothing where there are no k others.

    Copies of a vector are searched for once and are all returned.
    """
    source = points.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    distinct = settle(collapse_copies(source, "id", "vec"))
    per_vector = core_distances(build_blocks(distinct, block_rows), [k]).select("id", F.col("core")[0].alias("core_distance"))
    enough = (distinct.agg(F.sum("weight")).first()[0] or 0) > k
    return to_every_row(source, distinct, per_vector).filter(F.lit(enough)).select("id", "core_distance")


# ---- 2. minimum spanning tree ------------------------------------------------------------------

def _reachability(r, dims: int) -> np.ndarray:
    """Mutual reachability of the rows of a pair of nodes."""
    mr = np.sqrt(sq_distances(matrix(r.mat_a, dims), matrix(r.mat_b, dims)))
    return np.maximum(np.maximum(mr, matrix(r.core_a, 1)), matrix(r.core_b, 1).T)


def _contract(own: np.ndarray, other: np.ndarray, size: int) -> np.ndarray:
    """Where each of ``size`` vertices goes when every ``own`` vertex has taken its lightest edge, to ``other``."""
    up = np.arange(size)
    up[own] = other
    both = (up[up] == np.arange(size)) & (up > np.arange(size))  # two that took the same edge: the smaller stays
    up[both] = np.nonzero(both)[0]
    while (up[up] != up).any():
        up = up[up]
    return up


def light_forest(edges: pd.DataFrame) -> pd.DataFrame:
    """The lightest spanning forest of edges (w, lo, hi) between vertices u and v, ordered by (w, lo, hi)."""
    edges = edges.iloc[np.lexsort((edges["hi"], edges["lo"], edges["w"]))]
    names, code = np.unique(np.concatenate([edges["u"], edges["v"]]), return_inverse=True)
    u, v, at, kept = code[:len(edges)], code[len(edges):], np.arange(len(edges)), np.zeros(len(edges), dtype=bool)
    while True:
        open_ = u != v
        u, v, at = u[open_], v[open_], at[open_]
        if not len(at):
            return edges[kept]
        best = np.full(len(names), len(at))
        np.minimum.at(best, u, np.arange(len(at)))
        np.minimum.at(best, v, np.arange(len(at)))
        own = np.nonzero(best < len(at))[0]
        pick = best[own]
        kept[at[pick]] = True
        up = _contract(own, u[pick] + v[pick] - own, len(names))
        u, v = up[u], up[v]


def _pair_forests(dims: int):
    """The lightest spanning forest of the components among the rows of pairs of nodes, as edges (w, lo, hi, u, v).

    An edge of the whole tree lies in one pair and is in that pair's forest: no
    lighter path joins its ends anywhere.  So the forests hold the tree.
    """

    def forest(r) -> pd.DataFrame:
        ia, ib, ca, cb = longs(r.ids_a), longs(r.ids_b), longs(r.comp_a), longs(r.comp_b)
        by_a, by_b = np.argsort(ia), np.argsort(ib)  # by id: among equal weights the first is the least edge (w, lo, hi) of a row
        mr = np.ascontiguousarray(_reachability(r, dims)[np.ix_(by_a, by_b)])
        ia, ib, ca, cb = ia[by_a], ib[by_b], ca[by_a], cb[by_b]
        names, code = np.unique(np.concatenate([ca, cb]), return_inverse=True)
        va, vb = code[:len(ia)], code[len(ia):]
        back, found = np.ascontiguousarray(mr.T), []
        while True:
            same = va[:, None] == vb[None, :]
            np.copyto(mr, np.inf, where=same)
            np.copyto(back, np.inf, where=same.T)
            ja, jb = mr.argmin(1), back.argmin(1)
            w = np.concatenate([mr[np.arange(len(ia)), ja], back[np.arange(len(ib)), jb]])
            x, y = np.concatenate([ia, ib]), np.concatenate([ib[ja], ia[jb]])
            own, other = np.concatenate([va, vb]), np.concatenate([vb[ja], va[jb]])
            lo, hi = np.minimum(x, y), np.maximum(x, y)
            order = np.lexsort((hi, lo, w, own))
            order = order[np.isfinite(w[order])]
            if not len(order):
                return pd.concat(found, ignore_index=True) if found else None
            order = order[np.concatenate([[True], np.diff(own[order]) > 0])]
            edges = pd.DataFrame({"w": w, "lo": lo, "hi": hi, "u": np.concatenate([ca, cb]), "v": np.concatenate([cb[ja], ca[jb]])})
            found.append(edges.iloc[order].drop_duplicates(["lo", "hi"]))
            up = _contract(own[order], other[order], len(names))
            va, vb = up[va], up[vb]

    def run(frames):
        for pdf in frames:
            parts, size = [], 0
            for r in pdf.itertuples(index=False):
                part = forest(r)
                if part is not None:
                    parts.append(part)
                    size += len(part)
                if size > FLUSH_LINKS:
                    parts = [light_forest(pd.concat(parts, ignore_index=True))]
                    size = 0
            if parts:
                yield light_forest(pd.concat(parts, ignore_index=True))

    return run


def _lightest(dims: int):
    """Per component, the lightest edge leaving it among the rows of a block pair."""

    def one_side(mr, mine, ids, other_ids, other):
        w = mr.min(1)
        tie = mr == w[:, None]
        lo = np.where(tie, np.minimum(ids[:, None], other_ids[None, :]), BIG)
        tie &= lo == lo.min(1)[:, None]
        hi = np.where(tie, np.maximum(ids[:, None], other_ids[None, :]), BIG)
        at = hi.argmin(1)
        out = pd.DataFrame({"comp": mine, "w": w, "lo": lo.min(1), "hi": hi.min(1), "other": other[at]})
        out = out[np.isfinite(out["w"])].sort_values(["comp", "w", "lo", "hi"])
        return out.drop_duplicates("comp")

    def run(frames):
        for pdf in frames:
            parts = []
            for r in pdf.itertuples(index=False):
                ca, cb = longs(r.comp_a), longs(r.comp_b)
                mr = _reachability(r, dims)
                mr[ca[:, None] == cb[None, :]] = np.inf
                ia, ib = longs(r.ids_a), longs(r.ids_b)
                parts.append(one_side(mr, ca, ia, ib, cb))
                if r.a != r.b:
                    parts.append(one_side(mr.T, cb, ib, ia, ca))
            if parts:
                yield pd.concat(parts, ignore_index=True)

    return run


def spanning_tree(space: BlockSpace, cores: DataFrame, which: int = 0) -> DataFrame:
    """Edges (w, lo, hi) of the mutual reachability minimum spanning tree.

    Boruvka: in every round each component takes its lightest leaving edge.  The
    tree walk keeps a pair of nodes only while its lower bound does not exceed
    the best upper bound known for one of its components; bounds come from
    edges inside blocks and, for nodes of a single component, from the boxes.
    Where these bounds leave more than one in ``ONCE`` of all pairs open, rounds
    would compare nearly everything again and again: then all pairs of nodes
    are compared once, and the tree is taken from the forests of the tiles.
    Ties are broken by row ids, so no cycle can arise.
    """
    rows = settle(cores.select("block", "row", "id", F.col("core")[which].alias("core"), F.col("id").alias("comp")))
    base = space.packed.select("block", "n", "mat", "ids")
    found, kernel, schema = None, _lightest(space.dims), f"comp long, {EDGE}, other long"
    while True:
        state = rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("row", "core", "comp"))).alias("r")).select(
            "block", F.col("r.core").alias("core"), F.col("r.comp").alias("comp"))  # one block per group
        payload = settle(base.join(state, "block").mapInPandas(_as_bytes, "block long, n int, mat binary, ids binary, core binary, comp binary"))
        pairs, last = _open_pairs(space, payload, rows, kernel, schema)
        if last:
            forests = compare_rows(space, pairs, payload, PAYLOAD, _pair_forests(space.dims), f"{EDGE}, u long, v long", tile_bits=space.wide_bits)
            tree = spanning_forest(forests)
            return tree if found is None else settle(found.unionByName(tree))
        picked = compare_rows(space, pairs, payload, PAYLOAD, kernel, schema)
        best = settle(picked.groupBy("comp").agg(F.min(F.struct("w", "lo", "hi", "other")).alias("e")).select("comp", "e.*"))
        if best.isEmpty():
            return found if found is not None else best.select("w", "lo", "hi")
        edges = best.select("w", "lo", "hi").distinct()
        found = settle(edges if found is None else found.unionByName(edges))
        joined = _merged(best)
        rows = settle(rows.join(joined, "comp", "left").select("block", "row", "id", "core", F.coalesce("new", "comp").alias("comp")))


def _as_bytes(frames):
    for pdf in frames:
        pdf["core"] = [np.asarray(c, dtype=np.float64).tobytes() for c in pdf["core"]]
        pdf["comp"] = [np.asarray(c, dtype=np.int64).tobytes() for c in pdf["comp"]]
        yield pdf


def _merged(best: DataFrame) -> DataFrame:
    """(comp, new): the components that the lightest edges (comp, ..., other) join."""
    joined = connected_components(best.select(F.lit(0).alias("s"), F.col("comp").alias("u"), F.col("other").alias("v")))
    return joined.select(F.col("u").alias("comp"), F.col("comp").alias("new"))


def spanning_forest(edges: DataFrame, replay_limit: int = REPLAY) -> DataFrame:
    """Edges (w, lo, hi) of the lightest spanning forest of a table of edges (w, lo, hi, u, v), settled.

    Rounds join components over their lightest edges and keep one edge between
    two of them; what is checked to be at most ``replay_limit`` edges is solved in one task.
    """
    found, edges = None, settle(edges)
    while edges.limit(replay_limit + 1).count() > replay_limit:
        both = edges.select(F.col("u").alias("comp"), "w", "lo", "hi", F.col("v").alias("other")).unionByName(
            edges.select(F.col("v").alias("comp"), "w", "lo", "hi", F.col("u").alias("other")))
        best = settle(both.groupBy("comp").agg(F.min(F.struct("w", "lo", "hi", "other")).alias("e")).select("comp", "e.*"))
        picked = best.select("w", "lo", "hi").distinct()
        found = settle(picked if found is None else found.unionByName(picked))
        joined = settle(_merged(best))
        for side in ("u", "v"):
            edges = edges.join(joined.select(F.col("comp").alias(side), "new"), side, "left").withColumn(side, F.coalesce("new", side)).drop("new")
        ends = [F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")]
        edges = settle(edges.filter(F.col("u") != F.col("v")).groupBy(*ends).agg(F.min(F.struct("w", "lo", "hi")).alias("e")).select("e.*", "u", "v"))
    rest = edges.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(
        lambda pdf: light_forest(pdf)[["w", "lo", "hi"]], EDGE)
    return settle(rest if found is None else found.unionByName(rest))


def dendrogram(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Parents (a root is its own) of vertices 0 to n - 1 and of the nodes n, n + 1, ... that the edges of a forest form in order."""
    top, node, up = list(range(n)), list(range(n)), list(range(n + len(u)))

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for new, (a, b) in enumerate(zip(u.tolist(), v.tolist()), n):
        a, b = find(a), find(b)
        up[node[a]] = up[node[b]] = new
        top[b] = a
        node[a] = new
    return np.array(up, dtype=np.int64)


def _sizes(up: np.ndarray, leaves: np.ndarray) -> np.ndarray:
    size = [*leaves.tolist(), *[0] * (len(up) - len(leaves))]
    for x, to in enumerate(up.tolist()):  # a parent comes after its children
        if to != x:
            size[to] += size[x]
    return np.array(size, dtype=np.int64)


def _climb(up: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The first node from each one on upwards that is to stop at, or the root."""
    at = np.where(stop, np.arange(len(up)), up)
    while (at[at] != at).any():
        at = at[at]
    return at


def _left_open(pdf: pd.DataFrame) -> pd.DataFrame:
    """(id, reach): rows that an edge may still leave which is not in the forest, and how heavy it is at most (0: only from the other end).

    ``pdf``: rows (kind 0; w depth, lo id) and the forest's edges (kind 1).  A
    path to a row in the middle of the forest bounds an edge of the tree by the
    heaviest edge on it; no edge that is not listed is lighter than the depth
    of its ends.
    """
    own, links = pdf[pdf["kind"] == 0].sort_values("lo"), pdf[pdf["kind"] == 1].sort_values(["w", "lo", "hi"])
    ids, depth, w = own["lo"].to_numpy(), own["w"].to_numpy(), links["w"].to_numpy()
    n = len(ids)
    up = dendrogram(n, np.searchsorted(ids, links["lo"].to_numpy()), np.searchsorted(ids, links["hi"].to_numpy()))
    size, nodes = _sizes(up, np.ones(n, np.int64)), np.arange(len(up))
    inner = up != nodes
    heavy = np.zeros(len(up), np.int64)  # of a node's children the larger one, of equals the later
    order = nodes[inner][np.argsort(size[inner], kind="stable")]
    heavy[up[order]] = order
    spine = np.zeros(len(up), bool)
    at = int(size.argmax())
    while True:
        spine[at] = True
        if at < n:
            break
        at = int(heavy[at])
    joins = _climb(up, spine)[:n]
    reach = np.where(spine[joins], np.concatenate([np.zeros(n), w])[joins], np.inf) * (1 + 1e-9) + 1e-12
    some = depth <= reach
    if not some.any():
        return pd.DataFrame({"id": ids[:0], "reach": reach[:0]})
    asked = depth <= reach[some].max()
    return pd.DataFrame({"id": ids[asked], "reach": np.where(some, reach, 0.0)[asked]})


def _within_reach(dims: int):
    """Edges (w, lo, hi, u, v) between rows of pairs of nodes that are no heavier than the reach of one of them."""

    def run(frames):
        for pdf in frames:
            parts, size = [], 0
            for r in pdf.itertuples(index=False):
                reach = np.maximum(matrix(r.reach_a, 1), matrix(r.reach_b, 1).T)
                mr = _reachability(r, dims)
                i, j = np.nonzero(mr <= reach)
                x, y = longs(r.ids_a)[i], longs(r.ids_b)[j]
                lo, hi = np.minimum(x, y), np.maximum(x, y)
                part = pd.DataFrame({"w": mr[i, j], "lo": lo, "hi": hi, "u": lo, "v": hi})
                parts.append(part[x < y] if r.a == r.b else part)
                size += len(parts[-1])
                if size > FLUSH_LINKS:
                    parts = [light_forest(pd.concat(parts, ignore_index=True))]
                    size = 0
            if parts:
                yield light_forest(pd.concat(parts, ignore_index=True))

    return run


def tree_from_lists(space: BlockSpace, cores: DataFrame, which: int = 0) -> DataFrame:
    """Edges (w, lo, hi) of the mutual reachability minimum spanning tree, from listed nearest rows (``core_distances``).

    The lightest forest of the listed edges holds each of them that the tree
    holds.  An edge that is not listed is in the tree only if it is lighter
    than the forest's path between its ends; only rows that may have such edges
    are compared.  More rows than one task is to hold go to ``spanning_tree``.
    """
    rows = settle(cores.select("block", "row", "id", F.col("core")[which].alias("core"), "depth"))
    if rows.count() > REPLAY:
        return spanning_tree(space, cores, which)
    listed = cores.select("id", F.col("core")[which].alias("core"), F.explode("near").alias("x"))
    listed = listed.join(rows.select(F.col("id").alias("to"), F.col("core").alias("core_to")), F.col("x.id") == F.col("to"))
    ends = [F.least("id", "to").alias("lo"), F.greatest("id", "to").alias("hi")]
    listed = listed.select(F.greatest("core", "core_to", F.col("x.d")).alias("w"), *ends).groupBy("lo", "hi").agg(F.min("w").alias("w"))
    forest = spanning_forest(listed.select("w", "lo", "hi", F.col("lo").alias("u"), F.col("hi").alias("v")))
    both = rows.select(F.lit(0).alias("kind"), F.col("depth").alias("w"), F.col("id").alias("lo"), F.col("id").alias("hi")).unionByName(
        forest.select(F.lit(1).alias("kind"), "w", "lo", "hi"))
    asked = settle(both.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(lambda pdf: _left_open(pdf), "id long, reach double"))
    if asked.isEmpty():
        return forest
    state = rows.join(asked, "id").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("row", "core", "reach"))).alias("r"))  # one block per group
    dims = space.dims

    def pick(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                at = np.asarray(r.at, dtype=np.int64)
                out.append((r.block, len(at), matrix(r.mat, dims)[at].tobytes(), longs(r.ids)[at].tobytes(),
                            np.asarray(r.core, np.float64).tobytes(), np.asarray(r.reach, np.float64).tobytes(), float(np.max(r.reach))))
            yield pd.DataFrame(out, columns=["block", "n", "mat", "ids", "core", "reach", "search"])

    payload = settle(space.packed.select("block", "mat", "ids").join(state, "block").select(
        "block", "mat", "ids", F.col("r.row").alias("at"), F.col("r.core").alias("core"), F.col("r.reach").alias("reach")).mapInPandas(
        pick, "block long, n int, mat binary, ids binary, core binary, reach binary, search double"))

    def judge(cand, level):
        radius = F.greatest("search_a", "search_b")
        return verdict(cand.filter((radius > 0) & (box_gap2() <= radius * radius)), level, F.lit(False))

    pairs = descend(roll_up(payload.select("block", "search"), space, [F.max("search").alias("search")]), judge, space.floor)
    more = compare_rows(space, pairs, payload, ["mat", "ids", "core", "reach"], _within_reach(dims), f"{EDGE}, u long, v long")
    return spanning_forest(more.unionByName(forest.select("w", "lo", "hi", F.col("lo").alias("u"), F.col("hi").alias("v"))))


def _open_pairs(space: BlockSpace, payload: DataFrame, rows: DataFrame, kernel, schema: str) -> tuple[DataFrame, bool]:
    """Pairs of nodes (level ``space.floor``) that a round has to compare; or all that hold two components, and True."""
    spans = [F.min("comp_lo").alias("comp_lo"), F.max("comp_hi").alias("comp_hi")]
    pure = lambda s: F.col(f"comp_lo_{s}") == F.col(f"comp_hi_{s}")
    one = pure("a") & pure("b") & (F.col("comp_lo_a") == F.col("comp_lo_b"))

    def everything(nodes):
        slim = [n.select("node", "parent", "comp_lo", "comp_hi") for n in nodes]
        return descend(slim, lambda cand, level: verdict(cand.filter(~one), level, F.lit(False)), space.floor), True

    if space.levels == space.floor:  # one node
        return payload.select(F.shiftright("block", FAN_BITS * space.floor).alias("a")).distinct().select("a", F.col("a").alias("b")), True
    inf = F.lit(float("inf"))
    twice = [F.col(c).alias(f"{c}_{side}") for side in ("a", "b") for c in PAYLOAD]
    own = payload.select(F.col("block").alias("a"), F.col("block").alias("b"), *twice).mapInPandas(kernel, schema)
    bound = settle(own.groupBy("comp").agg(F.min("w").alias("ub")))
    leaf = rows.join(bound, "comp", "left").groupBy("block").agg(
        F.min("core").alias("core_lo"), F.max("core").alias("core_hi"), F.min("comp").alias("comp_lo"), F.max("comp").alias("comp_hi"),
        F.max(F.coalesce("ub", inf)).alias("ub"))
    nodes = roll_up(leaf, space, [F.min("core_lo").alias("core_lo"), F.max("core_hi").alias("core_hi"), *spans, F.max("ub").alias("ub")])
    known = [bound]

    def judge(cand, level):
        apart = (F.col("comp_hi_a") < F.col("comp_lo_b")) | (F.col("comp_hi_b") < F.col("comp_lo_a"))
        cand = settle(cand.filter(~one).withColumns({
            "low": F.greatest(F.sqrt(box_gap2()), "core_lo_a", "core_lo_b"), "high": F.greatest(F.sqrt(box_reach2()), "core_hi_a", "core_hi_b")}))
        seen = None
        for s in ("a", "b"):
            part = cand.filter(pure(s) & apart).select(F.col(f"comp_lo_{s}").alias("comp"), F.col("high").alias("ub"))
            seen = part if seen is None else seen.unionByName(part)
        known[0] = settle(known[0].unionByName(seen).groupBy("comp").agg(F.min("ub").alias("ub")))
        for s in ("a", "b"):
            better = known[0].select(F.col("comp").alias(f"comp_lo_{s}"), F.col("ub").alias("_ub"))
            cand = cand.join(better, f"comp_lo_{s}", "left").withColumn(
                f"ub_{s}", F.when(pure(s), F.least(f"ub_{s}", F.coalesce("_ub", inf))).otherwise(F.col(f"ub_{s}"))).drop("_ub")
        # Distances of pairs and bounds come from different sums: leave room for rounding.
        return verdict(cand.filter(F.col("low") <= F.greatest("ub_a", "ub_b") * (1 + 1e-9) + 1e-12), level, F.lit(False))

    pairs = descend(nodes, judge, space.floor)
    n = nodes[space.floor].count()
    return everything(nodes) if pairs.count() * ONCE > n * (n + 1) // 2 else (pairs, False)


# ---- 3. hierarchy ------------------------------------------------------------------------------

def _replay(tree: DataFrame, members: DataFrame, m: int) -> DataFrame:
    """Edges in order; a row's edge is fixed when its component has grown."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, links = pdf[pdf["kind"] == 0].sort_values("lo"), pdf[pdf["kind"] == 1].sort_values(["w", "lo", "hi"])
        ids, weight = own["lo"].to_numpy(), own["hi"].to_numpy()
        up = dendrogram(len(ids), np.searchsorted(ids, links["lo"].to_numpy()), np.searchsorted(ids, links["hi"].to_numpy()))
        grown = _sizes(up, weight) >= m
        at = _climb(up, grown)[:len(ids)]
        edges = {c: np.concatenate([own[c] if c == "w" else np.full(len(ids), -1), links[c]])[at] for c in ("w", "lo", "hi")}
        return pd.DataFrame({"id": ids, **edges})[grown[at]]

    both = members.select(F.lit(0).alias("kind"), F.col("core").alias("w"), F.col("id").alias("lo"), F.col("weight").alias("hi")).unionByName(
        tree.select(F.lit(1).alias("kind"), "w", "lo", "hi"))
    found = both.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(run, "id long, w double, lo long, hi long")
    return members.select("id").join(found.select("id", F.struct("w", "lo", "hi").alias("t")), "id", "left")


def fall_out(tree: DataFrame, members: DataFrame, min_cluster_size: int, replay_limit: int = REPLAY) -> DataFrame:
    """(id, t): the tree edge at which the row's component reaches ``min_cluster_size``; null if never.

    A tree checked to have at most ``replay_limit`` edges is replayed edge by
    edge in one task.  Beyond that, in rounds: a small component next to a grown one falls out over its lightest
    edge, and so does every component whose chain of lightest edges ends at a
    grown one; otherwise the two components at the end of the chain merge.
    """
    m = min_cluster_size
    if members.limit(replay_limit + 1).count() <= replay_limit:  # a tree has fewer edges than rows
        return _replay(tree, members, m)
    start = F.struct(F.col("core").alias("w"), F.lit(-1).cast("long").alias("lo"), F.lit(-1).cast("long").alias("hi"))
    rows = settle(members.select("id", F.col("id").alias("c"), F.when(F.col("weight") >= m, start).alias("t")))
    comps = settle(members.select(F.col("id").alias("c"), F.col("weight").alias("size")))
    edges = settle(tree.select(F.struct("w", "lo", "hi").alias("e"), F.col("lo").alias("cu"), F.col("hi").alias("cv")))
    grown = settle(comps.filter(F.col("size") >= m).select("c"))
    while True:
        both = edges.select("e", F.col("cu").alias("c"), F.col("cv").alias("to")).unionByName(
            edges.select("e", F.col("cv").alias("c"), F.col("cu").alias("to")))
        least = both.join(grown, "c", "left_anti").groupBy("c").agg(F.min(F.struct("e", "to")).alias("x")).select("c", "x.e", "x.to")
        least = settle(least.join(grown.select(F.col("c").alias("to"), F.lit(True).alias("up")), "to", "left").withColumn("up", F.coalesce("up", F.lit(False))))
        if least.isEmpty():
            return rows.select("id", "t")
        # Grown targets become one dead end per component, so chains do not run through them.
        chain = connected_components(least.select(
            F.lit(0).alias("s"), F.col("c").alias("u"), F.when(F.col("up"), -F.col("c") - 2).otherwise(F.col("to")).alias("v")))
        placed = least.join(chain.select(F.col("u").alias("c"), F.col("comp").alias("chain")), "c")
        anchored = placed.groupBy("chain").agg(F.max("up").alias("anchored"))
        placed = settle(placed.join(anchored, "chain"))
        done = placed.filter("anchored").select("c", "e")
        pair = placed.filter("not anchored")
        mutual = pair.alias("x").join(pair.alias("y"), (F.col("x.to") == F.col("y.c")) & (F.col("y.to") == F.col("x.c")) & (F.col("x.c") < F.col("y.c")))
        mutual = mutual.join(comps.select(F.col("c").alias("c1"), F.col("size").alias("s1")), F.col("x.c") == F.col("c1")).join(
            comps.select(F.col("c").alias("c2"), F.col("size").alias("s2")), F.col("y.c") == F.col("c2"))
        mutual = settle(mutual.select("c1", "c2", F.col("x.e").alias("e"), (F.col("s1") + F.col("s2")).alias("size")))
        renamed = mutual.select(F.col("c2").alias("c"), F.col("c1").alias("new"))
        born = mutual.filter(F.col("size") >= m)
        fixed = settle(done.unionByName(born.select(F.col("c1").alias("c"), "e")).unionByName(born.select(F.col("c2").alias("c"), "e")))
        rows = settle(
            rows.join(fixed, "c", "left").join(renamed, "c", "left")
            .select("id", F.coalesce("new", "c").alias("c"), F.coalesce("t", "e").alias("t")))
        comps = settle(
            comps.join(renamed.select("c"), "c", "left_anti").join(mutual.select(F.col("c1").alias("c"), F.col("size").alias("sum")), "c", "left")
            .select("c", F.coalesce("sum", "size").alias("size")))
        grown = settle(grown.unionByName(done.select("c")).unionByName(born.select(F.col("c1").alias("c"))))
        for side in ("cu", "cv"):
            edges = edges.join(renamed.select(F.col("c").alias(side), "new"), side, "left").withColumn(side, F.coalesce("new", side)).drop("new")
        edges = settle(edges.filter(F.col("cu") != F.col("cv")))


class ClusterTree:
    """Dendrogram over the leaf clusters, as arrays (small: one node per significant split)."""

    def __init__(self, leaves: Sequence[int], merges: Sequence[tuple]):
        self.leaf = {g: i for i, g in enumerate(sorted(leaves))}
        n = len(self.leaf)
        self.parent = list(range(n + len(merges)))
        self.formed = [(-1.0, -1, -1)] * n + [m[:3] for m in merges]
        self.kids: dict[int, tuple[int, int]] = {}
        top = list(range(n))

        def find(x):
            while top[x] != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        for k, (w, lo, hi, gu, gv) in enumerate(merges):
            a, b, new = find(self.leaf[gu]), find(self.leaf[gv]), n + k
            top.append(new)
            top[a] = top[b] = new
            self.parent[a] = self.parent[b] = new
            self.kids[new] = (a, b)
        self.root = n + len(merges) - 1 if merges else 0

    def holder(self, leaf_no: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Node that holds a row of a leaf when it falls out at edge ``t``: the highest one formed before."""
        steps, up = [], np.array(self.parent)
        while True:
            steps.append(up)
            if (up[up] == up).all():
                break
            up = up[up]
        # Internal nodes are numbered in merge order, so a row passes every node formed before its edge.
        keys = self.formed[len(self.leaf):]
        limit = len(self.leaf) + np.array([bisect_left(keys, e) for e in zip(t["w"], t["lo"], t["hi"])], dtype=np.int64)
        node = leaf_no.copy()
        for up in reversed(steps):
            ahead = up[node]
            node = np.where(ahead < limit, ahead, node)
        return node

    def select(self, fallen: dict[int, tuple[float, float]]) -> dict[int, int]:
        """node -> selected ancestor by excess of mass; ``fallen[node]`` = (weight, sum weight * lambda)."""
        lam = lambda w: 1.0 / max(w, 1e-300)
        n = len(self.parent)
        size, score, chosen = [0.0] * n, [0.0] * n, [True] * n
        for node in range(n):
            birth = 0.0 if node == self.root else lam(self.formed[self.parent[node]][0])
            weight, mass = fallen.get(node, (0.0, 0.0))
            own = mass - weight * birth
            size[node] = weight
            if node in self.kids:
                split = lam(self.formed[node][0])
                for kid in self.kids[node]:
                    own += size[kid] * (split - birth)
                    size[node] += size[kid]
                below = sum(score[kid] for kid in self.kids[node])
                chosen[node] = own >= below and node != self.root
                score[node] = own if chosen[node] else below
            else:
                chosen[node] = node != self.root
                score[node] = own
        out: dict[int, int] = {}
        for node in range(n - 1, -1, -1):
            above = out.get(self.parent[node]) if node != self.root else None
            if above is not None:
                out[node] = above
            elif chosen[node]:
                out[node] = node
        return out


def condense(tree: DataFrame, members: DataFrame, min_cluster_size: int) -> DataFrame:
    """(id, label) from the spanning tree; members: id, weight, core."""
    heights = settle(fall_out(tree, members, min_cluster_size))
    at = lambda side: heights.select(F.col("id").alias(side), F.col("t").alias(f"t_{side}"))
    edge = F.struct("w", "lo", "hi")
    judged = settle(tree.join(at("lo"), "lo").join(at("hi"), "hi").withColumn("split", F.coalesce((F.col("t_lo") < edge) & (F.col("t_hi") < edge), F.lit(False))))
    groups = connected_components(judged.filter(~F.col("split")).select(F.lit(0).alias("s"), F.col("lo").alias("u"), F.col("hi").alias("v")))
    groups = groups.select(F.col("u").alias("id"), F.col("comp").alias("g"))
    rows = settle(members.join(heights, "id").join(groups, "id", "left").select("id", "weight", "t", F.coalesce("g", "id").alias("g")))
    of = lambda side: rows.select(F.col("id").alias(side), F.col("g").alias(f"g_{side}"))
    merges = judged.filter("split").join(of("lo"), "lo").join(of("hi"), "hi").select("w", "lo", "hi", "g_lo", "g_hi").collect()
    merges = sorted(tuple(r) for r in merges)
    if not merges:
        return rows.select("id", F.lit(-1).alias("label"))
    built = ClusterTree({g for m in merges for g in m[3:]}, merges)

    def hold(frames):
        for pdf in frames:
            leaf = pdf["g"].map(built.leaf).to_numpy(np.int64)
            yield pd.DataFrame({"id": pdf["id"], "weight": pdf["weight"], "w": pdf["w"], "node": built.holder(leaf, pdf)})

    held = settle(rows.filter(F.col("t").isNotNull()).select("id", "weight", "g", "t.*").mapInPandas(hold, "id long, weight long, w double, node long"))
    mass = held.groupBy("node").agg(F.sum("weight").alias("n"), F.sum(F.col("weight") / F.greatest("w", F.lit(1e-300))).alias("m")).collect()
    picked = built.select({r["node"]: (float(r["n"]), float(r["m"])) for r in mass})
    if not picked:
        return rows.select("id", F.lit(-1).alias("label"))
    table = tree.sparkSession.createDataFrame(sorted(picked.items()), "node long, pick long")
    named = held.join(table, "node")
    numbers = number_groups(named.groupBy("pick").agg(F.min("id").alias("first_id")).withColumn("s", F.lit(0)), "s", "first_id", "label")
    labelled = named.join(numbers.select("pick", F.col("label").cast("int").alias("label")), "pick").select("id", "label")
    return rows.select("id").join(labelled, "id", "left").select("id", F.coalesce("label", F.lit(-1)).alias("label"))


def hdbscan_grid(points: DataFrame, settings: Sequence[tuple[int, int]], id_col: str, vec_col: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(setting, id, label) for (min_cluster_size, min_samples) pairs.

    One neighbour search serves all settings, one spanning tree each min_samples.
    """
    source = points.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    distinct = settle(collapse_copies(source, "id", "vec"))
    space = build_blocks(distinct, block_rows)
    ks = sorted({k for _, k in settings})
    cores = settle(core_distances(space, ks, NEAREST))
    out = None
    for which, k in enumerate(ks):
        tree = tree_from_lists(space, cores, which)
        members = settle(cores.select("id", "weight", F.col("core")[which].alias("core")))
        for number, (size, need) in enumerate(settings):
            if need == k:
                part = condense(tree, members, size).select(F.lit(number).alias("setting"), "id", "label")
                out = part if out is None else out.unionByName(part)
    return to_every_row(source, distinct, out).select("setting", "id", "label")


def hdbscan(points: DataFrame, min_cluster_size: int, min_samples: int, id_col: str, vec_col: str, **options) -> DataFrame:
    return hdbscan_grid(points, [(min_cluster_size, min_samples)], id_col, vec_col, **options).select("id", "label")
