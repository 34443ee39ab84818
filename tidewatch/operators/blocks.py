"""Spatial blocks: the shared base of all distance operators.

Vectors are ordered along a space-filling curve over their principal axes, cut
into blocks of at most ``BLOCK_ROWS`` rows and summarised by bounding boxes on
these axes and by their distances to a few pivots.  Both form a tree with
fan-out 16.  A distance predicate is decided for whole nodes wherever boxes or
the triangle inequality allow it, walking the tree from the root; only
undecided pairs of blocks ever compare rows, inside a task, and what leaves the
task is an aggregate or a spanning forest, never the list of pairs.  Undecided
pairs are dealt out in square tiles, so a block travels once per tile; a tile
grows with the data, up to ``TILE_ROWS`` rows a side, so until then every block
travels a fixed number of times.  Blocks of few rows are compared as the nodes
above them, of at most ``BLOCK_ROWS`` rows: a comparison costs no less for
fewer rows.  Block size is bounded by construction, so a dense region becomes
more blocks, not a bigger task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import settle

BLOCK_ROWS = 512
FAN_BITS = 4
CURVE_DIMS, CURVE_BITS = 4, 12
CURVE_CUTS = 5  # halvings of a curve axis before the next axis joins in
PIVOT_SPREAD = 3.0
ROUNDING = 1e-12  # boxes are this much wider, relative to the numbers they come from
TILE_BITS = 3  # a tile holds at least 8 x 8 block pairs where there are so many
STRIPE_BITS = 5  # blocks are cut into up to 32 stripes, two of which make a tile
WIDE_STRIPE_BITS = 4  # the same where almost all pairs meet: fewer travels, larger tasks
TILE_ROWS = 65_536
TURNS = (64, 16)  # of all nodes, the parts that are compared with a node in the first turns, on either side of it
TURNS_FROM = 256  # nodes; a turn more takes longer than comparing all of fewer
BOUNDS = ["lo", "hi", "near", "far"]
PACKED = ("part long, seq long, n int, ids binary, mat binary, weights binary, tags binary, lo array<double>, hi array<double>, "
          "near array<double>, far array<double>, weight long, min_tag long")


class Frame(NamedTuple):
    """Principal axes of a set of vectors; distances are the same in it, boxes are tighter."""

    mean: np.ndarray    # dims
    axes: np.ndarray    # dims x dims, a column each, widest first
    spread: np.ndarray  # standard deviation along each axis
    turns: int          # widest axes that the curve runs over

    def place(self, mat: np.ndarray) -> np.ndarray:
        return (mat - self.mean) @ self.axes

    def pivots(self) -> np.ndarray:
        """The mean, and two points on each of the widest axes, in frame coordinates."""
        d = len(self.mean)
        ends = np.eye(d)[:CURVE_DIMS] * (PIVOT_SPREAD * self.spread[:CURVE_DIMS, None])
        return np.vstack([np.zeros((1, d)), ends, -ends])


def fit_frame(points: DataFrame, block_rows: int = BLOCK_ROWS) -> Frame | None:
    """Frame of the column ``vec`` from one pass over its sums and products; None without rows.

    Few blocks are cut along two axes only: thin slices of many axes would
    leave every block as long as the data in all the others.
    """

    def sums(frames):
        total = None
        for pdf in frames:
            if len(pdf):
                m = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
                part = np.concatenate([[len(m)], m.sum(0), (m.T @ m).ravel()])
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total), dtype=np.int32), "x": total})

    rows = points.select("vec").mapInPandas(sums, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()  # 1 + dims + dims^2 rows
    if not rows:
        return None
    x = np.array([r["x"] for r in sorted(rows)])
    d = int((np.sqrt(4 * len(x) - 3) - 1) / 2 + 0.5)
    mean = x[1:d + 1] / x[0]
    turns = min(d, CURVE_DIMS, max(2, int(np.log2(max(x[0] / block_rows, 1.0))) // CURVE_CUTS))
    cov = x[d + 1:].reshape(d, d) / x[0] - np.outer(mean, mean)
    if not np.isfinite(cov).all():
        return Frame(np.nan_to_num(mean, posinf=0.0, neginf=0.0), np.eye(d), np.ones(d), turns)
    power, axes = np.linalg.eigh(cov)
    return Frame(mean, np.ascontiguousarray(axes[:, ::-1]), np.sqrt(np.maximum(power[::-1], 0.0)), turns)


class BlockSpace(NamedTuple):
    packed: DataFrame   # one row per block: block, n, ids, mat, weights, tags, bounds, weight, min_tag
    nodes: list         # nodes[l]: node, parent, bounds, weight
    levels: int
    dims: int
    frame: Frame
    block_rows: int = BLOCK_ROWS
    floor: int = 0      # level of the nodes whose rows are compared
    tile_bits: int = TILE_BITS
    wide_bits: int = TILE_BITS


def _curve_key(vec: Column, frame: Frame) -> Column:
    """Interleaved bits of the position on the widest axes (Morton order), in cells that hold about as many rows each."""
    key = F.lit(0).cast("long")
    for j in range(frame.turns):
        axis = F.array(*[F.lit(float(x)) for x in frame.axes[:, j]])
        along = F.aggregate(F.zip_with(vec, axis, lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x) - F.lit(float(frame.mean @ frame.axes[:, j]))
        share = F.lit(1.0) / (F.lit(1.0) + F.exp(along * F.lit(-1.7 / (float(frame.spread[j]) or 1.0))))  # close to the normal distribution
        cell = F.floor(share * (2**CURVE_BITS - 1)).cast("long")
        for bit in range(CURVE_BITS):
            one = F.shiftright(cell, bit).bitwiseAND(F.lit(1).cast("long"))
            key = key.bitwiseOR(F.shiftleft(one, bit * frame.turns + frame.turns - 1 - j))
    return key


def _pack(rows_per_block: int, frame: Frame):
    pivots = frame.pivots()
    base = np.abs(frame.mean).max(initial=0.0) + np.abs(pivots).max(initial=0.0)

    def bounds(m):
        """Box on the frame's axes and least and largest distance to each pivot, wide enough for rounding."""
        pad = ROUNDING * len(frame.mean) * (np.abs(m).max(initial=0.0) + base)
        y = frame.place(m)
        d = np.sqrt(((y[:, None, :] - pivots[None]) ** 2).sum(2))
        return [(y.min(0) - pad).tolist(), (y.max(0) + pad).tolist(), (d.min(0) - pad).tolist(), (d.max(0) + pad).tolist()]

    def pack(frames):
        held: list[tuple] = []
        size = seq = 0
        part = 0

        def emit(last):
            nonlocal held, size, seq
            ids, mat, w, tag = (np.concatenate([h[i] for h in held]) for i in range(4))
            rows = []
            at = 0
            while at < len(ids):
                left = len(ids) - at
                if left < 2 * rows_per_block:
                    if not last:
                        break
                    # The rest is cut evenly, so no block is left almost empty.
                    step = left if left <= rows_per_block else (left + 1) // 2
                else:
                    step = rows_per_block
                cut = slice(at, at + step)
                m = np.ascontiguousarray(mat[cut])
                tags = tag[cut]
                real = tags[tags >= 0]
                rows.append((part, seq, len(m), ids[cut].tobytes(), m.tobytes(), w[cut].tobytes(), tags.tobytes(),
                             *bounds(m), int(w[cut].sum()), int(real.min()) if len(real) else -1))
                seq += 1
                at += step
            held = [(ids[at:], mat[at:], w[at:], tag[at:])] if at < len(ids) else []
            size = max(len(ids) - at, 0)
            return pd.DataFrame(rows, columns=[c.split()[0] for c in PACKED.split(", ")])

        for pdf in frames:
            if not len(pdf):
                continue
            part = int(pdf["part"].iloc[0])
            held.append((pdf["id"].to_numpy(np.int64), np.stack(pdf["vec"].to_numpy()).astype(np.float64),
                         pdf["weight"].to_numpy(np.int64), pdf["tag"].to_numpy(np.int64)))
            size += len(pdf)
            if size >= 2 * rows_per_block:
                yield emit(False)
        if size:
            yield emit(True)

    return pack


def pack_blocks(points: DataFrame, block_rows: int, frame: Frame) -> DataFrame:
    """``points`` (id, vec, weight, tag) in curve order as one row per block (see PACKED), settled."""
    placed = (
        points.withColumn("_z", _curve_key(F.col("vec"), frame)).repartitionByRange("_z", "id").sortWithinPartitions("_z", "id")
        .select(F.spark_partition_id().cast("long").alias("part"), "id", "vec", "weight", "tag")
    )
    return settle(placed.mapInPandas(_pack(block_rows, frame), PACKED))


def number_blocks(packed: DataFrame) -> tuple[DataFrame, int]:
    """Packed blocks with their number ``block`` in curve order, and the bits it takes."""
    top = packed.agg(F.max("part").alias("p"), F.max("seq").alias("s")).first()
    shift = int(top["s"] or 0).bit_length()
    bits = int(top["p"] or 0).bit_length() + shift
    return packed.withColumn("block", F.shiftleft("part", shift).bitwiseOR(F.col("seq"))).drop("part", "seq"), bits


def tile_width(bits: int, rows: int, stripe_bits: int = STRIPE_BITS) -> int:
    """Bits of the side of a tile, for numbers of ``bits`` bits that stand for up to ``rows`` rows each."""
    return max(min(TILE_BITS, bits), min(bits - stripe_bits, max(TILE_ROWS // rows, 1).bit_length() - 1))


def _corner(name: str, size: int, pick: Callable[[Column], Column]) -> Column:
    """Smallest or largest value at each place of the arrays of a group (at most 16 children)."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: pick(F.transform(F.collect_list(name), lambda c: c[i]))).alias(name)


def parent_nodes(nodes: DataFrame, frame: Frame, aggs: Sequence[Column] = ()) -> DataFrame:
    """The next level of a box tree."""
    dims, pivots = len(frame.mean), len(frame.pivots())
    return nodes.groupBy(F.shiftright("node", FAN_BITS).alias("node")).agg(
        _corner("lo", dims, F.array_min), _corner("hi", dims, F.array_max), _corner("near", pivots, F.array_min), _corner("far", pivots, F.array_max), *aggs)


def build_blocks(points: DataFrame, block_rows: int = BLOCK_ROWS) -> BlockSpace:
    """``points``: id long, vec array<double>, weight long, tag long (-1 = none)."""
    frame = fit_frame(points, block_rows) or Frame(np.zeros(0), np.zeros((0, 0)), np.zeros(0), 0)
    packed, bits = number_blocks(pack_blocks(points, block_rows, frame))
    levels = -(-bits // FAN_BITS)
    floor = min(levels, (max(BLOCK_ROWS // block_rows, 1).bit_length() - 1) // FAN_BITS)
    nodes = [packed.select(F.col("block").alias("node"), *BOUNDS, "weight")]
    for _ in range(levels):
        nodes.append(parent_nodes(nodes[-1], frame, [F.sum("weight").alias("weight")]))
    nodes = [n.withColumn("parent", F.shiftright("node", FAN_BITS)) for n in nodes]
    width = [tile_width(bits - FAN_BITS * floor, block_rows << FAN_BITS * floor, b) for b in (STRIPE_BITS, WIDE_STRIPE_BITS)]
    return BlockSpace(packed, nodes, levels, len(frame.mean), frame, block_rows, floor, *width)


def box_gap2(a: str = "a", b: str = "b") -> Column:
    """Squared distance that no row pair of a candidate pair is closer than: between the boxes, or by a pivot."""
    def apart(least, most):
        one = F.zip_with(f"{least}_{b}", f"{most}_{a}", lambda x, y: x - y)
        other = F.zip_with(f"{least}_{a}", f"{most}_{b}", lambda x, y: x - y)
        return F.zip_with(one, other, lambda x, y: F.greatest(x, y, F.lit(0.0)))

    box = F.aggregate(apart("lo", "hi"), F.lit(0.0), lambda s, x: s + x * x)
    pivot = F.aggregate(apart("near", "far"), F.lit(0.0), lambda s, x: F.greatest(s, x))
    return F.greatest(box, pivot * pivot)


def box_reach2(a: str = "a", b: str = "b") -> Column:
    """Squared distance that no row pair is further apart than: between the far corners, or by way of a pivot."""
    span = F.zip_with(F.zip_with(f"hi_{b}", f"lo_{a}", lambda x, y: x - y), F.zip_with(f"hi_{a}", f"lo_{b}", lambda x, y: x - y), lambda x, y: F.greatest(x, y))
    box = F.aggregate(span, F.lit(0.0), lambda s, x: s + x * x)
    around = F.array_min(F.zip_with(f"far_{a}", f"far_{b}", lambda x, y: x + y))
    return F.least(box, around * around)


def sides(df: DataFrame, side: str, drop: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}_{side}") for c in df.columns if c not in drop])


def descend(nodes: list, judge, floor: int = 0) -> DataFrame:
    """Walk pairs a <= b of tree nodes from the root to the blocks, or to the nodes of level ``floor``.

    ``nodes[l]`` holds the nodes of level l with whatever bounds the caller
    needs.  ``judge(candidates, level)`` gets columns ``*_a`` and ``*_b`` and
    returns the surviving pairs as (level, a, b, full); ``full`` pairs are not
    expanded.  Result: all full pairs plus the remaining pairs of the last level, settled.
    """
    top = len(nodes) - 1
    root = nodes[top]
    judged = judge(sides(root, "a").join(sides(root, "b"), F.col("node_a") == F.col("node_b")), top)  # one row
    judged = judged if top > floor else settle(judged)
    done = judged.filter("full") if top > floor else judged
    for level in range(top - 1, floor - 1, -1):
        active = judged.filter(~F.col("full")).select("a", "b")
        cand = (
            active.join(sides(nodes[level], "a"), F.col("a") == F.col("parent_a"))
            .join(sides(nodes[level], "b"), F.col("b") == F.col("parent_b"))
            .filter(F.col("node_a") <= F.col("node_b")).drop("a", "b")
        )
        judged = settle(judge(cand, level))
        done = done.unionByName(judged if level == floor else judged.filter("full"))
    return done


def verdict(cand: DataFrame, level: int, full: Column) -> DataFrame:
    return cand.select(F.lit(level).alias("level"), F.col("node_a").alias("a"), F.col("node_b").alias("b"), full.alias("full"))


def block_pairs(space: BlockSpace, near: float, far: float) -> DataFrame:
    """Pairs of tree nodes that can hold rows within ``far`` of each other.

    ``full``: every row pair is within ``near`` (decided at any level, then not
    expanded).  Otherwise the row is a pair of nodes (level ``space.floor``) to be compared.
    A negative ``near`` decides nothing early.
    """
    near2 = near * near if near >= 0 else -1.0
    return descend(space.nodes, lambda cand, level: verdict(cand.filter(box_gap2() <= far * far), level, box_reach2() <= near2), space.floor)


def roll_up(leaf: DataFrame, space: BlockSpace, aggs: list[Column]) -> list:
    """Box tree with extra per-node columns, aggregated from per-block values."""
    out, current = [], leaf.withColumnRenamed("block", "node")
    for level in range(space.levels + 1):
        if level:
            current = current.groupBy(F.shiftright("node", FAN_BITS).alias("node")).agg(*aggs)
        out.append(settle(space.nodes[level].join(current, "node")))
    return out


def deal_tiles(pairs: DataFrame, bits: int = TILE_BITS) -> tuple[DataFrame, DataFrame]:
    """Pairs with their tile (ta, tb), and the blocks (ta, tb, block) that each tile needs."""
    dealt = pairs.select("a", "b", F.shiftright("a", bits).alias("ta"), F.shiftright("b", bits).alias("tb"))
    return dealt, dealt.select("ta", "tb", F.explode(F.array("a", "b")).alias("block")).distinct()


def compare_rows(space: BlockSpace, pairs: DataFrame, packed: DataFrame, cols: list[str], kernel, schema: str, combine=None,
                 tile_bits: int | None = None) -> DataFrame:
    """What ``kernel`` makes of pairs of nodes with their payload ``cols`` (columns a, b, *_a, *_b), a frame per tile.

    Pairs are dealt out in square tiles; a block travels once to every tile
    that needs it, not once per pair, and a task holds one tile's blocks.  The
    binary payload of a node's blocks is joined; ``at`` holds each row's place,
    block * block_rows + row.  ``combine`` reduces a tile's rows before they
    leave the task.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    block_rows, up = space.block_rows, FAN_BITS * space.floor
    dealt, wanted = deal_tiles(pairs, space.tile_bits if tile_bits is None else tile_bits)
    blocks = packed.select(F.shiftright("block", up).alias("node"), F.col("block"), "n", *cols)
    payload = wanted.select(F.col("ta").alias("pa"), F.col("tb").alias("pb"), F.col("block").alias("node")).join(blocks, "node")

    def run(pairs, blocks):
        held = {}
        for node, part in blocks.sort_values("block").groupby("node"):
            held[node] = {c: b"".join(part[c]) for c in cols}
            held[node]["at"] = np.concatenate([b * block_rows + np.arange(n) for b, n in zip(part["block"], part["n"])]).tobytes()
        pairs = pairs[["a", "b"]].sort_values(["a", "b"], ignore_index=True)
        frame = pairs.assign(**{f"{c}_{s}": [held[x][c] for x in pairs[s]] for c in [*cols, "at"] for s in ("a", "b")})
        parts = [x for x in kernel(iter([frame])) if len(x)]
        if not parts:
            return pd.DataFrame(columns=names)
        out = pd.concat(parts, ignore_index=True)
        return combine(out) if combine else out

    return dealt.groupBy("ta", "tb").cogroup(payload.groupBy("pa", "pb")).applyInPandas(run, schema)


def in_turns(space: BlockSpace, pairs: DataFrame) -> list[DataFrame]:
    """Pairs of nodes to be compared, parted into turns: nodes close on the curve come first, all others last.

    For comparisons that have less left to do the more is known.  Few nodes are
    compared in one turn.
    """
    top = space.nodes[space.floor].agg(F.max("node")).first()[0]
    if top is None or top + 1 < TURNS_FROM:
        return [pairs]
    gap, ends = F.col("b") - F.col("a"), [(top + 1) // part for part in TURNS]
    turns = [pairs.filter((gap > low) & (gap <= high)) for low, high in zip([-1, *ends], ends)]
    return [*turns, pairs.filter(gap > ends[-1])]


def ancestors(df: DataFrame, levels: int, block: str = "block") -> DataFrame:
    """One row per block and tree level: (level, node)."""
    at = F.sequence(F.lit(0), F.lit(levels))
    return df.withColumn("level", F.explode(at)).withColumn("node", F.expr(f"shiftright({block}, level * {FAN_BITS})"))


def both_ways(full: DataFrame) -> DataFrame:
    """Decided node pairs as (level, node, other), each direction once."""
    return full.select("level", F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        full.filter("a <> b").select("level", F.col("b").alias("node"), F.col("a").alias("other")))
