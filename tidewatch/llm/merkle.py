"""Merkle manifest of a table: one tree per group, the groups' subroots under one root, and a proof for every row.

A node is the SHA-256 (lowercase hex) of its children's digests as hex text, one
after the other; every two consecutive nodes of a level become one, and a last
one alone is hashed by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce
from itertools import zip_longest
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from tidewatch.operators.ranks import running_total
from tidewatch.session import settle

STEP = 10  # levels that one task climbs: a leaf partition holds up to 2**STEP leaves
ASKERS = 12  # a node is asked for by at most 2**ASKERS leaf partitions under one key
STEPS = ArrayType(StructType([StructField("left", BooleanType()), StructField("digest", StringType())]))


class Tree(NamedTuple):
    """Settled tables of one tree per group.

    blocks: _group, n, height, block, leaves array<struct<pos, leaf, row>>: the leaf partitions.
    nodes:  _group, n, height, level, idx, digest: from the leaf partitions' roots up to the subroots.
    """

    blocks: DataFrame
    nodes: DataFrame


class Manifest(NamedTuple):
    """The groups' trees; groups: _group, n, subroot and path, the steps from subroot to root; root: None of an empty table."""

    tree: Tree
    groups: DataFrame
    root: str | None


def leaf_digest(*cols: Column) -> Column:
    """SHA-256 of the values one after the other: ``-`` for null, else UTF-8 byte count, ``:`` and the value."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(part, cols)), 256)


def climb(digests: Sequence[str], height: int) -> list[list[str]]:
    """The nodes of each level from ``digests`` up, ``height`` levels."""
    out = [list(digests)]
    for _ in range(height):
        row = out[-1]
        out.append([hashlib.sha256((a + b).encode()).hexdigest() for a, b in zip_longest(row[::2], row[1::2], fillvalue="")])
    return out


def missing_nodes(known: Iterable[int], n: int) -> list[tuple[int, int]]:
    """Octopus: the (level, index) of all nodes that proofs of the ``known`` leaves need and that do not follow from these leaves.

    Level by level a known node's sibling is missing unless it is known too;
    the parents of known nodes are known on the next level.  Nothing is listed
    twice and nothing that can be derived is listed.
    """
    out, level, held = [], 0, set(known)
    while n > 1:
        out += [(level, i ^ 1) for i in sorted(held) if i ^ 1 not in held and i ^ 1 < n]
        held = {i >> 1 for i in held}
        n, level = (n + 1) // 2, level + 1
    return out


def expand_proofs(leaves: dict[int, str], n: int, fetched: dict[tuple[int, int], str]) -> dict[int, list[tuple[bool | None, str | None]]]:
    """Steps (is the sibling on the left, its digest) from each leaf to the root of n leaves; (None, None) where a node stands alone.

    ``fetched`` are the nodes of ``missing_nodes``; interiors that several
    proofs share are derived once.
    """
    known, level = [dict(leaves)], 0
    sizes = [n]
    while sizes[-1] > 1:
        row, n = known[-1], sizes[-1]
        row.update({i: d for (at, i), d in fetched.items() if at == level})
        known.append({p: hashlib.sha256((row[2 * p] + (row[2 * p + 1] if 2 * p + 1 < n else "")).encode()).hexdigest()
                      for p in {i >> 1 for i in row} if 2 * p in row and (2 * p + 1 >= n or 2 * p + 1 in row)})
        sizes.append((n + 1) // 2)
        level += 1
    out = {}
    for leaf in leaves:
        steps, i = [], leaf
        for row, size in zip(known[:-1], sizes):
            steps.append((bool(i & 1), row[i ^ 1]) if i ^ 1 < size else (None, None))
            i >>= 1
        out[leaf] = steps
    return out


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    joined = lambda acc, s: F.when(s["digest"].isNull(), acc).when(s["left"], F.concat(s["digest"], acc)).otherwise(F.concat(acc, s["digest"]))
    return F.aggregate(steps, leaf, lambda acc, s: F.sha2(joined(acc, s), 256))


def siblings(steps: Column) -> Column:
    """The digests of a proof in order."""
    return F.transform(F.filter(steps, lambda s: s["digest"].isNotNull()), lambda s: s["digest"])


def _run_arrow(df: DataFrame, make: Callable[[pa.RecordBatch], Iterator[list[pa.Array]]], schema: StructType) -> DataFrame:
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for arrays in make(batch):
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.mapInArrow(run, schema)


def _climb_rows(packed: DataFrame, below: bool) -> DataFrame:
    """(_group, n, height, level, idx, digest, open): the nodes above each row's ``digests``, which begin at (level, first).

    STEP levels, or as many as the tree has left; with ``below`` all of them,
    else the highest alone, which is marked ``open``.
    """
    def make(batch: pa.RecordBatch) -> Iterator[list[pa.Array]]:
        kind = batch.schema.field(0).type
        for g, n, height, level, first, digests in zip(*(c.to_pylist() for c in batch.columns)):
            found = [(level + up, (first >> up) + k, d) for up, row in enumerate(climb(digests, min(STEP, height - level))) for k, d in enumerate(row)]
            top = level + min(STEP, height - level)
            found = [f for f in found if f[0] == top or (below and f[0] > level)]
            levels, at, found = zip(*found)
            size = len(at)
            yield [pa.array([g] * size, kind), pa.array([n] * size, pa.int64()), pa.array([height] * size, pa.int64()), pa.array(levels, pa.int64()),
                   pa.array(at, pa.int64()), pa.array(found, pa.string()), pa.array([at_level == top for at_level in levels], pa.bool_())]

    whole = [StructField(c, LongType()) for c in ("n", "height", "level", "idx")]
    schema = StructType([packed.schema["_group"], *whole, StructField("digest", StringType()), StructField("open", BooleanType())])
    return _run_arrow(packed.select("_group", "n", "height", "level", "first", "digests"), make, schema)


def grow(placed: DataFrame, most: int) -> Tree:
    """Trees over leaves (_group, n, height, pos, leaf, row); ``most`` is the largest height."""
    key = ["_group", "n", "height"]
    kids = F.sort_array(F.collect_list(F.struct("pos", "leaf", "row")))  # at most 2**STEP
    blocks = settle(placed.groupBy(*key, F.shiftright("pos", STEP).alias("block")).agg(kids.alias("leaves")))
    zero = F.lit(0).cast("long")
    tables = [settle(_climb_rows(blocks.select(*key, zero.alias("level"), F.shiftleft("block", STEP).alias("first"), F.col("leaves.leaf").alias("digests")), False))]
    for level in range(STEP, most, STEP):  # the open nodes of the last round, 2**STEP siblings a row
        todo = tables[-1].filter((F.col("level") == level) & F.col("open") & (F.col("level") < F.col("height")))
        packed = todo.groupBy(*key, "level", F.shiftright("idx", STEP).alias("up")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("kids"))
        tables.append(settle(_climb_rows(packed.select(*key, "level", F.shiftleft("up", STEP).alias("first"), F.col("kids.digest").alias("digests")), True)))
    return Tree(blocks, reduce(DataFrame.unionByName, tables).drop("open"))


def _copies(level: int) -> int:
    """So many copies of a node at this level are laid out: half of the 2**level leaves below its parent ask for it."""
    return 1 << max(0, level - STEP - ASKERS)


def prove_tree(tree: Tree) -> DataFrame:
    """(_group, pos, leaf, row, steps): every leaf with its proof up to its group's subroot.

    Each leaf partition lists the nodes it lacks (``missing_nodes``), all lists
    are met with the stored nodes in one join, and what was found comes back
    to the partition in one row.  Nodes near a subroot, for which everybody
    asks, lie in copies, so that no key of the join meets more than 2**ASKERS
    lists; the copies of all levels are fewer than the leaf partitions.
    """
    key = tree.blocks.schema["_group"]

    def ask(batch: pa.RecordBatch) -> Iterator[list[pa.Array]]:
        for g, n, block, held in zip(*(c.to_pylist() for c in batch.columns)):
            lacks = missing_nodes(held, n)
            if lacks:
                levels, at = zip(*lacks)
                salt = [block % _copies(level) for level in levels]
                yield [pa.array([g] * len(at), batch.schema.field(0).type), *(pa.array(v, pa.int64()) for v in ([block] * len(at), levels, at, salt))]

    asked = _run_arrow(
        tree.blocks.select("_group", "n", "block", "leaves.pos"), ask, StructType([key, *[StructField(c, LongType()) for c in ("block", "level", "idx", "salt")]]))
    copies = F.expr(f"shiftleft(1L, int(greatest(level - {STEP + ASKERS}, 0)))")
    held = tree.nodes.select(
        F.col("_group").alias("_g"), F.col("level").alias("_level"), F.col("idx").alias("_idx"), "digest", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("_copy"))
    met = asked.join(held, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("level") == F.col("_level")) & (F.col("idx") == F.col("_idx")) & (F.col("salt") == F.col("_copy")))
    fetched = met.groupBy(F.col("_group").alias("_g"), F.col("block").alias("_b")).agg(F.collect_list(F.struct("level", "idx", "digest")).alias("fetched"))  # one a level at most
    joined = tree.blocks.join(fetched, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_b")), "left").select("_group", "n", "leaves", "fetched")

    def expand(batch: pa.RecordBatch) -> Iterator[list[pa.Array]]:
        for k in range(batch.num_rows):
            part = batch.slice(k, 1)
            leaves = part.column(2).flatten()
            at, digests = leaves.field("pos"), leaves.field("leaf")
            got = {(f["level"], f["idx"]): f["digest"] for f in part.column(3)[0].as_py() or []}
            proofs = expand_proofs(dict(zip(at.to_pylist(), digests.to_pylist())), part.column(1)[0].as_py(), got)
            flat = [step for p in at.to_pylist() for step in proofs[p]]
            steps = pa.StructArray.from_arrays(
                [pa.array([s[0] for s in flat], pa.bool_()), pa.array([s[1] for s in flat], pa.string())], names=["left", "digest"])
            each = len(flat) // len(at)
            ends = pa.array(range(0, len(flat) + 1, each) if each else [0] * (len(at) + 1), pa.int32())
            group = pa.array([part.column(0)[0].as_py()] * len(at), batch.schema.field(0).type)
            yield [group, at, digests, leaves.field("row"), pa.ListArray.from_arrays(ends, steps)]

    row = tree.blocks.schema["leaves"].dataType.elementType["row"]
    return _run_arrow(joined, expand, StructType([key, StructField("pos", LongType()), StructField("leaf", StringType()), row, StructField("steps", STEPS)]))


def build_manifest(rows: DataFrame, leaf: Column, group: str = "lang", order: Sequence[str] = ("doc_id",), carry: Sequence[Column] = ()) -> Manifest:
    """Trees over ``rows``, a leaf each, per value of ``group``, and one tree over the groups' subroots.

    Leaves ascend by ``order`` and then by digest, nulls first; rows equal in
    all of these are leaves of their own in any order.  Groups ascend by value,
    null first (a group like any other), strings bytewise.  Positions come from
    range partitions and their offsets, so a group or key that holds most rows
    is split; a leaf partition has at most 2**STEP leaves and is climbed on its
    own, and the partitions' roots are climbed in rounds of STEP levels.
    ``carry`` are columns to show beside the proofs (types that can be sorted);
    long texts are read once, for their digest.  An empty table has no groups
    and no root.
    """
    own = F.struct(*[c.alias(c_name) for c_name, c in zip(rows.select(*carry).columns, carry)]) if carry else F.struct(F.lit(None).cast("int").alias("_none"))
    leaves = settle(rows.select(
        own.alias("row"), F.col(f"`{group}`").alias("_group"), *[F.col(f"`{c}`").alias(f"_o{k}") for k, c in enumerate(order)], leaf.alias("leaf"),
        F.monotonically_increasing_id().alias("_tie")))
    sizes = running_total(leaves.groupBy("_group").agg(F.count(F.lit(1)).alias("n")), ["_group"], "n", "_end")
    groups = settle(running_total(sizes, ["_group"], out="_rank").select(
        "_group", "n", F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0).cast("long").alias("height"), (F.col("_end") - F.col("n")).alias("_start"), (F.col("_rank") - 1).alias("_rank")))
    count, most = groups.agg(F.count(F.lit(1)), F.max("height")).first()
    at = groups.select(F.col("_group").alias("_g"), "n", "height", "_start")
    placed = running_total(leaves, ["_group", *[f"_o{k}" for k in range(len(order))], "leaf", "_tie"], out="_upto").join(at, F.col("_group").eqNullSafe(F.col("_g")))
    tree = grow(placed.withColumn("pos", F.col("_upto") - 1 - F.col("_start")), most or 0)
    # The same once more, with the groups for leaves.
    height = max(count - 1, 0).bit_length()
    subroots = tree.nodes.filter("level = height").select(F.col("_group").alias("_g"), F.col("digest").alias("leaf"))
    named = groups.join(subroots, F.col("_group").eqNullSafe(F.col("_g"))).select(
        F.lit(0).alias("_group"), F.lit(count).cast("long").alias("n"), F.lit(height).cast("long").alias("height"), F.col("_rank").alias("pos"), "leaf",
        F.struct(F.col("_group").alias("value"), F.col("n").alias("n")).alias("row"))
    top = grow(named, height)
    root = top.nodes.filter("level = height").first()
    paths = prove_tree(top).select(F.col("row.value").alias("_group"), F.col("row.n").alias("n"), F.col("leaf").alias("subroot"), F.col("steps").alias("path"))
    return Manifest(tree, settle(paths), root["digest"] if root else None)


def prove_rows(manifest: Manifest) -> DataFrame:
    """(row, pos, leaf, subroot, root, steps): every row of the manifest with its proof from leaf to root."""
    paths = manifest.groups.select(F.col("_group").alias("_g"), "subroot", "path")
    proofs = prove_tree(manifest.tree).join(paths, F.col("_group").eqNullSafe(F.col("_g")))
    return proofs.select("row", "pos", "leaf", "subroot", F.lit(manifest.root).cast("string").alias("root"), F.concat("steps", "path").alias("steps"))
