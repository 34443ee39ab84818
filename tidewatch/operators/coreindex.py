"""Stored block index of core rows, probed by new rows.

The index is written once, when a detector is fitted: blocks of core rows in
curve order, the box tree above them, and a small header.  Blocks lie in
shelves, a folder of up to 16 neighbouring blocks each.  New rows walk the tree
first; only the shelves that the walk could not decide are opened, so a
micro-batch reads what lies near it, however many core rows are stored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.operators.blocks import (
    BLOCK_ROWS, BOUNDS, FAN_BITS, Frame, box_gap2, box_reach2, build_blocks, number_blocks, pack_blocks, parent_nodes, tile_width)
from tidewatch.operators.dbscan import NOISE, collapse_copies
from tidewatch.operators.kernels import longs, matrix, sq_distances
from tidewatch.session import fresh_path, settle

NODE = "node long, parent long, level int, lo array<double>, hi array<double>, near array<double>, far array<double>, min_tag long"
BLOCK = "block long, mat binary, tags binary, lo array<double>, hi array<double>, near array<double>, far array<double>, min_tag long, shelf long"


@dataclass
class CoreIndex:
    path: str
    levels: int            # level of the root; shelves are the nodes of level 1
    frame: Frame | None    # None: no core rows
    block_rows: int = BLOCK_ROWS


def build_core_index(cores: DataFrame, path: str | None = None, block_rows: int = BLOCK_ROWS) -> CoreIndex:
    """Index of core rows (vec, label) at ``path``, by default in the scratch folder; of equal vectors the smallest label stays."""
    spark = cores.sparkSession
    path = path or fresh_path(spark, "cores")
    known = cores.groupBy(F.col("vec").cast("array<double>").alias("vec")).agg(F.min(F.col("label").cast("long")).alias("tag"))
    numbered = settle(known.select("vec", "tag", F.lit(-1).cast("long").alias("id"), F.lit(1).cast("long").alias("weight")))
    if numbered.isEmpty():
        index = CoreIndex(path, 1, None, block_rows)
        _write_header(spark, index)
        return index
    space = build_blocks(numbered, block_rows)
    blocks = space.packed.select("block", "mat", "tags", *BOUNDS, "min_tag", F.shiftright("block", FAN_BITS).alias("shelf"))
    blocks.repartition("shelf").sortWithinPartitions("shelf", "block").write.partitionBy("shelf").parquet(f"{path}/shelves")
    level = space.packed.select(F.col("block").alias("node"), *BOUNDS, "min_tag")
    tree = None
    for k in range(1, max(space.levels, 1) + 1):
        level = parent_nodes(level, space.frame, [F.min("min_tag").alias("min_tag")])
        part = level.select("node", F.shiftright("node", FAN_BITS).alias("parent"), F.lit(k).alias("level"), *BOUNDS, "min_tag")
        tree = part if tree is None else tree.unionByName(part)
    tree.write.partitionBy("level").parquet(f"{path}/tree")
    index = CoreIndex(path, max(space.levels, 1), space.frame, block_rows)
    _write_header(spark, index)
    return index


def _write_header(spark: SparkSession, index: CoreIndex) -> None:
    f = index.frame
    body = {"levels": index.levels, "block_rows": index.block_rows, "frame": None if f is None else [f.mean.tolist(), f.axes.tolist(), f.spread.tolist()], "turns": f.turns if f else 0}
    spark.createDataFrame([(json.dumps(body),)], "value string").coalesce(1).write.mode("overwrite").text(f"{index.path}/header")


def open_core_index(spark: SparkSession, path: str) -> CoreIndex:
    body = json.loads(spark.read.text(f"{path}/header").first()[0])
    frame = None if body["frame"] is None else Frame(*[np.array(x, np.float64) for x in body["frame"]], body["turns"])
    return CoreIndex(path, body["levels"], frame, body["block_rows"])


def copy_core_index(spark: SparkSession, index: CoreIndex, path: str) -> CoreIndex:
    """The same index at another path (part of saving a detector)."""
    if index.frame is not None:
        spark.read.schema(BLOCK).parquet(f"{index.path}/shelves").repartition("shelf").sortWithinPartitions("shelf", "block").write.mode("overwrite").partitionBy("shelf").parquet(f"{path}/shelves")
        spark.read.schema(NODE).parquet(f"{index.path}/tree").write.mode("overwrite").partitionBy("level").parquet(f"{path}/tree")
    copied = CoreIndex(path, index.levels, index.frame, index.block_rows)
    _write_header(spark, copied)
    return copied


def near_shelves(asked: DataFrame, index: CoreIndex, eps: float) -> DataFrame:
    """(a, node, full, tag) settled: for each block of new rows the tree nodes within reach, walked from the root.

    ``full``: every core row below the node is within eps of every new row,
    ``tag`` its smallest label; such a node is not opened.  The others are
    shelves (nodes of level 1).  All levels are one plan.
    """
    spark = asked.sparkSession
    tree = spark.read.schema(NODE).parquet(f"{index.path}/tree")
    mine = [f"{c}_a" for c in BOUNDS]
    active = asked.select(F.col("block").alias("a"), *[F.col(c).alias(f"{c}_a") for c in BOUNDS]).withColumns({
        "node": F.lit(0).cast("long"), "full": F.lit(False), "tag": F.lit(None).cast("long")})
    for level in range(index.levels, 0, -1):  # the root is its own parent's only child
        kids = tree.filter(F.col("level") == level).select(F.col("parent").alias("up"), F.col("node").alias("kid"), F.col("min_tag").alias("kid_tag"), *[F.col(c).alias(f"{c}_b") for c in BOUNDS])
        met = active.join(kids, ~F.col("full") & (F.col("node") == F.col("up")), "left").filter(F.col("full") | (F.col("kid").isNotNull() & (box_gap2() <= eps * eps)))
        active = met.select(
            "a", *mine, F.when(F.col("full"), F.col("node")).otherwise(F.col("kid")).alias("node"),
            (F.col("full") | (box_reach2() <= eps * eps)).alias("full"), F.when(F.col("full"), F.col("tag")).otherwise(F.col("kid_tag")).alias("tag"))
    return settle(active.select("a", "node", "full", "tag"))


def _contact_tiles(eps: float, dims: int, block_rows: int):
    """Smallest label near each row of a tile's new blocks.

    Blocks are met in the order of their smallest label; a row that already has
    a smaller one is not compared.
    """
    step = max(1, BLOCK_ROWS // block_rows)
    far = np.iinfo(np.int64).max

    def run(pairs, blocks):
        bounds = lambda rows, c: np.stack(rows[c].to_numpy()).astype(np.float64)
        shelves = {}
        for shelf, part in blocks[blocks["stored"]].groupby("node"):
            part = part.sort_values(["min_tag", "block"])
            shelves[shelf] = (part["min_tag"].to_numpy(np.int64), list(part["mat"]), list(part["tags"]), {c: bounds(part, c) for c in BOUNDS})
        out = []
        wanted = pairs.groupby("a")["b"].apply(list)
        for r in blocks[~blocks["stored"]].itertuples(index=False):
            mine, best = matrix(r.mat, dims), np.full(r.n, far)
            box = {c: np.asarray(getattr(r, c), np.float64) for c in BOUNDS}
            for shelf in sorted(wanted[r.node], key=lambda x: (int(shelves[x][0][0]), x)):
                least, mats, tags, near = shelves[shelf]
                side = lambda lo, hi: np.maximum(np.maximum(near[lo] - box[hi], box[lo] - near[hi]), 0.0)
                gap2 = np.maximum((side("lo", "hi") ** 2).sum(1), side("near", "far").max(1) ** 2)
                span = np.maximum(near["hi"] - box["lo"], box["hi"] - near["lo"])
                reach2 = np.minimum((span ** 2).sum(1), (near["far"] + box["far"]).min(1) ** 2)
                whole = reach2 <= eps * eps
                if whole.any():
                    best = np.minimum(best, least[whole].min())
                rest = np.nonzero(~whole & (gap2 <= eps * eps))[0]
                for at in range(0, len(rest), step):
                    some = rest[at:at + step]
                    rows = np.nonzero(best > least[some[0]])[0]
                    if not len(rows):
                        break
                    b, names = matrix(b"".join(mats[k] for k in some), dims), longs(b"".join(tags[k] for k in some))
                    hit = sq_distances(mine[rows], b, (eps,)) <= eps * eps
                    best[rows] = np.minimum(best[rows], np.where(hit, names[None, :], far).min(1, initial=far))
            out.append(pd.DataFrame({"id": longs(r.ids)[best < far], "label": best[best < far]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"id": [], "label": []}).astype("int64")

    return run


def _spread_label(frames):
    for pdf in frames:
        for r in pdf.itertuples(index=False):
            ids = longs(r.ids)
            yield pd.DataFrame({"id": ids, "label": np.full(len(ids), r.tag, np.int64)})


def probe_cores(fresh: DataFrame, index: CoreIndex, eps: float, id_col: str, vec_col: str) -> DataFrame:
    """(id, label): smallest label of the core rows within ``eps`` of each new row, else -1.

    Blocks of new rows and the shelves that the walk leaves open meet in tiles,
    so either travels a bounded number of times until a tile is full.  The list
    of shelves to open passes through the driver: one number per 16 blocks of
    core rows at most.
    """
    spark = fresh.sparkSession
    new = fresh.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    if index.frame is None:
        return new.select("id", F.lit(NOISE).alias("label"))
    # Rows with equal vectors get equal answers: one row per distinct vector.
    asked = settle(collapse_copies(new, "id", "vec"))
    # A comparison costs no less for fewer rows: the new rows' blocks are not smaller than usual.
    size = max(index.block_rows, BLOCK_ROWS)
    packed, bits = number_blocks(pack_blocks(asked, size, index.frame))
    near = near_shelves(packed, index, eps)
    decided = near.filter("full").select("a", "tag")
    shelves = [r[0] for r in near.filter("not full").select("node").distinct().collect()]
    best = None
    if shelves:
        opened = spark.read.schema(BLOCK).option("basePath", f"{index.path}/shelves").parquet(*[f"{index.path}/shelves/shelf={s}" for s in shelves])
        shift = tile_width(max(shelves).bit_length(), index.block_rows << FAN_BITS)
        dealt = near.filter("not full").select("a", F.col("node").alias("b"), F.shiftright("a", tile_width(bits, size)).alias("ta"), F.shiftright("node", shift).alias("tb"))
        wanted = lambda side: dealt.select(F.col("ta").alias("pa"), F.col("tb").alias("pb"), F.col(side).alias("node")).distinct()
        none = lambda c, kind: F.lit(None).cast(kind).alias(c)
        mine = wanted("a").join(packed.select(F.col("block").alias("node"), F.lit(False).alias("stored"), "block", "n", "ids", "mat", none("tags", "binary"), "min_tag", *BOUNDS), "node")
        theirs = wanted("b").join(opened.select(F.col("shelf").alias("node"), F.lit(True).alias("stored"), "block", F.lit(0).alias("n"), none("ids", "binary"), "mat", "tags", "min_tag", *BOUNDS), "node")
        best = dealt.groupBy("ta", "tb").cogroup(mine.unionByName(theirs).groupBy("pa", "pb")).applyInPandas(
            _contact_tiles(eps, len(index.frame.mean), index.block_rows), "id long, label long")
    decided = decided.groupBy(F.col("a").alias("block")).agg(F.min("tag").alias("tag"))
    wide = packed.select("block", "ids").join(decided, "block").select("ids", "tag").mapInPandas(_spread_label, "id long, label long")
    best = (wide if best is None else wide.unionByName(best)).groupBy("id").agg(F.min("label").alias("label"))
    answer = asked.select("vec", "id").join(best, "id", "left").select("vec", F.coalesce("label", F.lit(NOISE)).cast("int").alias("label"))
    return new.join(answer, "vec").select("id", "label")


def _least_kernel(dims: int):
    def run(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                a, b = matrix(r.mat_a, dims), matrix(r.mat_b, dims)
                gap = a - b[sq_distances(a, b).argmin(1)]
                out.append(pd.DataFrame({"id": longs(r.ids_a), "distance": np.sqrt((gap * gap).sum(1))}))
            if out:
                yield pd.concat(out, ignore_index=True)

    return run


def nearest_cores(fresh: DataFrame, index: CoreIndex, id_col: str, vec_col: str) -> DataFrame:
    """(id, distance) to the nearest stored row; none without stored rows.

    One walk down the tree: at each level a block of new rows keeps the nodes
    that are no further than the surest of them reaches.
    """
    spark = fresh.sparkSession
    new = fresh.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    if index.frame is None:
        return new.select("id", F.lit(None).cast("double").alias("distance")).filter("false")
    asked = settle(collapse_copies(new, "id", "vec"))
    packed = pack_blocks(asked, index.block_rows, index.frame).withColumn("block", F.shiftleft("part", 32).bitwiseOR(F.col("seq")))
    mine = [F.col(c).alias(f"{c}_a") for c in BOUNDS]
    tree = spark.read.schema(NODE).parquet(f"{index.path}/tree")

    def closest(cand: DataFrame) -> DataFrame:
        sure = F.min(box_reach2()).over(Window.partitionBy("a"))
        return cand.withColumn("_sure", sure).filter(box_gap2() <= F.col("_sure"))

    active = packed.select(F.col("block").alias("a"), *mine, F.lit(0).cast("long").alias("node"))
    for level in range(index.levels, 0, -1):
        kids = tree.filter(F.col("level") == level).select(F.col("parent").alias("up"), F.col("node").alias("kid"), *[F.col(c).alias(f"{c}_b") for c in BOUNDS])
        active = closest(active.join(kids, F.col("node") == F.col("up"))).select("a", *[f"{c}_a" for c in BOUNDS], F.col("kid").alias("node"))
    near = settle(active.select("a", "node"))
    shelves = [r[0] for r in near.select("node").distinct().collect()]
    if not shelves:
        return new.select("id", F.lit(None).cast("double").alias("distance")).filter("false")
    opened = spark.read.schema(BLOCK).option("basePath", f"{index.path}/shelves").parquet(*[f"{index.path}/shelves/shelf={s}" for s in shelves])
    boxes = opened.select("shelf", F.col("block").alias("b"), *[F.col(c).alias(f"{c}_b") for c in BOUNDS])
    met = near.join(boxes, F.col("node") == F.col("shelf")).join(packed.select(F.col("block").alias("a"), *mine), "a")
    pairs = settle(closest(met).select("a", "b"))
    rows = (
        pairs.join(packed.select(F.col("block").alias("a"), F.col("mat").alias("mat_a"), F.col("ids").alias("ids_a")), "a")
        .join(opened.select(F.col("block").alias("b"), F.col("mat").alias("mat_b")), "b"))
    best = rows.mapInPandas(_least_kernel(len(index.frame.mean)), "id long, distance double").groupBy("id").agg(F.min("distance").alias("distance"))
    return new.join(asked.select("vec", F.col("id").alias("_first")), "vec").join(best.withColumnRenamed("id", "_first"), "_first").select("id", "distance")


def dbscan_assign(fresh: DataFrame, cores: DataFrame, eps: float, id_col: str, vec_col: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Score new rows against core rows that have no index yet: smallest cluster with a core row within eps, else -1."""
    return probe_cores(fresh, build_core_index(cores, block_rows=block_rows), eps, id_col, vec_col)
