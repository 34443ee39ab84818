"""SimHash near-duplicates: a hierarchical index over fingerprints in Gray order."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidewatch.llm.common import content_key
from tidewatch.operators.components import connected_components
from tidewatch.session import settle

BITS = 64
BLOCK = 256  # fingerprints in a leaf block
LEAF = 16  # fingerprints in a group of the block
FAN_BITS = 4  # 16 children to a node
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LANES = np.uint64(0x0101010101010101)
SHINGLE, MOST = 3, 2  # words of a shingle, differing bits of a link


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit set: eight lanes of a byte are added at once, 255 rows at a time."""
    counts = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 255 * 256):
        part = hashes[start:start + 255 * 256]
        rows = np.zeros(-(-len(part) // 255) * 255, np.uint64)
        rows[:len(part)] = part
        rows = rows.reshape(-1, 255)
        for shift in range(8):
            lanes = ((rows >> np.uint64(shift)) & LANES).sum(axis=1, dtype=np.uint64)
            counts[shift::8] += lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return counts


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each word shingle of a UTF-8 text, A-Z in lower case; a text with fewer words is one shingle."""
    found = text.translate(LOWER).split()  # without arguments: exactly space and 0x09 to 0x0D
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in found), np.int64, len(found))) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends[shingle - 1:].tolist() if len(found) >= shingle else [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends)), np.uint64, len(ends))


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have, as a signed 64-bit number."""
    bits = (2 * bit_counts(hashes) > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes, shingle: int) -> int:
    """SimHash of a UTF-8 text; 0 where there is no word."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, columns: Sequence[str], shingle: int = SHINGLE, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """The given columns and ``out``, the SimHash of the whole text over word shingles (repeats included)."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary())
            marks = [fingerprint(t.as_py() or b"", shingle) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(marks, pa.int64())], names=[*batch.schema.names[:-1], out])

    kept = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{text}`").alias("_text"))
    return kept.mapInArrow(probe, StructType([*kept.schema.fields[:-1], StructField(out, LongType())]))


def gray_rank(code: Column) -> Column:
    """Place of a code in the Gray sequence, as a long whose signed order is the unsigned one."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(-(2**63)).cast("long"))


def gray_code(rank: Column) -> Column:
    """The code at a place of the Gray sequence: the inverse of ``gray_rank``."""
    plain = rank.bitwiseXOR(F.lit(-(2**63)).cast("long"))
    return plain.bitwiseXOR(F.shiftrightunsigned(plain, 1))


def build_index(codes: DataFrame, code: str = "fp") -> tuple[DataFrame, int]:
    """Codes -> leaf blocks (block, ones, some, codes), numbered from 0 in Gray order, and their number.

    ``ones`` are the bits that all codes of a block have, ``some`` those that
    any has: where they agree, the bit is shared by the whole block.
    """
    order = settle(
        codes.select(gray_rank(F.col(code)).alias("rank")).repartitionByRange("rank").sortWithinPartitions("rank")
        .select("rank", F.spark_partition_id().alias("part"), F.expr(f"(monotonically_increasing_id() & {2**33 - 1}L) div {BLOCK}").alias("nth")))
    parts = order.groupBy("part").agg((F.max("nth") + 1).alias("n"))
    # One row per partition: bounded by the shuffle width, not by the data.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    blocks = (
        order.withColumn("code", gray_code(F.col("rank"))).groupBy("part", "nth")
        .agg(F.expr("bit_and(code)").alias("ones"), F.expr("bit_or(code)").alias("some"), F.sort_array(F.collect_list("rank")).alias("held"))
        .join(F.broadcast(bases), "part")
        .select((F.col("base") + F.col("nth")).alias("block"), "ones", "some", F.transform("held", gray_code).alias("codes")))
    return settle(blocks), parts.agg(F.sum("n")).first()[0] or 0


def shared_differences(a: str, b: str) -> Column:
    """In how many of the bits that each of two nodes shares they differ: no pair below them differs in fewer."""
    fixed = lambda x: F.bitwise_not(F.col(f"{x}_ones").bitwiseXOR(F.col(f"{x}_some")))
    return F.bit_count(F.col(f"{a}_ones").bitwiseXOR(F.col(f"{b}_ones")).bitwiseAND(fixed(a)).bitwiseAND(fixed(b)))


def block_pairs(blocks: DataFrame, n_blocks: int, most: int) -> DataFrame:
    """(a, b) with a <= b: the pairs of leaf blocks that may hold codes at ``most`` differing bits or fewer.

    Starts at the root paired with itself and replaces each pair of nodes by
    the pairs of their children; a pair is dropped as soon as its shared bits
    differ too often, with all that lies below it.
    """
    depth = 0
    while (n_blocks - 1) >> (FAN_BITS * depth) > 0:
        depth += 1
    pairs = blocks.select((F.col("block") * 0).alias("a"), (F.col("block") * 0).alias("b")).distinct()
    for level in range(depth - 1, -1, -1):
        node = F.shiftright("block", FAN_BITS * level)
        nodes = blocks.groupBy(node.alias("node")).agg(F.expr("bit_and(ones)").alias("ones"), F.expr("bit_or(some)").alias("some"))
        nodes = settle(nodes) if level < depth - 1 else nodes
        side = lambda x: nodes.select(F.shiftright("node", FAN_BITS).alias(x), F.col("node").alias(f"{x}_node"), F.col("ones").alias(f"{x}_ones"), F.col("some").alias(f"{x}_some"))  # noqa: B023, E731
        pairs = settle(
            pairs.join(side("a"), "a").join(side("b"), "b").filter((F.col("a_node") <= F.col("b_node")) & (shared_differences("a", "b") <= most))
            .select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))
    return pairs


def close_codes(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs at ``most`` differing bits or fewer; groups of 16 are held against each other first."""
    def groups(x):
        cut = np.arange(0, len(x), LEAF)
        ones, some = np.bitwise_and.reduceat(x, cut), np.bitwise_or.reduceat(x, cut)
        pad = np.zeros(-(-len(x) // LEAF) * LEAF, np.uint64)
        pad[:len(x)] = x
        return ones, ~(ones ^ some), pad.reshape(-1, LEAF)

    (a1, af, ax), (b1, bf, bx) = groups(a), groups(b)
    gi, gj = np.nonzero(np.bitwise_count((a1[:, None] ^ b1[None, :]) & af[:, None] & bf[None, :]) <= most)
    p, i, j = np.nonzero(np.bitwise_count(ax[gi][:, :, None] ^ bx[gj][:, None, :]) <= most)
    i, j = gi[p] * LEAF + i, gj[p] * LEAF + j
    real = (i < len(a)) & (j < len(b))
    return i[real], j[real]


def forest(u: np.ndarray, v: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Of the links (u, v) over n vertices, enough to keep what they connect: fewer than n."""
    parent = list(range(n))
    kept = []
    for x, y in zip(u.tolist(), v.tolist()):
        a, b = x, y
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a != b:
            parent[b] = a
            kept.append((x, y))
    return kept


def links(codes: DataFrame, most: int, code: str = "fp") -> DataFrame:
    """(u, v): links between distinct codes at ``most`` differing bits or fewer, as a forest for every pair of blocks."""
    blocks, n_blocks = build_index(codes, code)
    pairs = block_pairs(blocks, n_blocks, most)
    left = blocks.select(F.col("block").alias("a"), F.col("codes").alias("left"))
    right = blocks.select(F.col("block").alias("b"), F.col("codes").alias("right"))
    tiles = pairs.join(left, "a").join(right, "b").select((F.col("a") == F.col("b")).alias("same"), "left", "right")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for k in range(batch.num_rows):
                x = batch.column(1)[k].values.to_numpy(zero_copy_only=False).view(np.uint64)
                same = batch.column(0)[k].as_py()
                y = x if same else batch.column(2)[k].values.to_numpy(zero_copy_only=False).view(np.uint64)
                i, j = close_codes(x, y, most)
                if same:
                    i, j = i[i < j], j[i < j]
                elif len(j):
                    j = j + len(x)
                both = x if same else np.concatenate([x, y])
                if len(i) > 1:
                    kept = forest(i, j, len(both))
                    i, j = np.array([e[0] for e in kept]), np.array([e[1] for e in kept])
                us.append(both[i].view(np.int64))
                vs.append(both[j].view(np.int64))
            none = [np.empty(0, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us or none)), pa.array(np.concatenate(vs or none))], names=["u", "v"])

    return tiles.mapInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST, doc_id: str = "doc_id", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, the columns named in ``carry``, fingerprint (long), class_code (long) and component_id.

    A fingerprint has a bit where more than half of the hashes of the word
    shingles have it; a text with fewer words is one shingle, one without
    words (null, empty, blank) has fingerprint 0.  Fingerprints link at
    ``most`` differing bits or fewer, each distinct one once; component_id is
    the smallest doc_id that links reach and class_code a fingerprint that
    names the class.  Null ids name no component, so one without other ids has
    a null component_id; repeated rows get the same answer.
    """
    marked = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), *[F.col(f"`{c}`") for c in carry if c != "doc_id"], F.col(f"`{text}`").alias("_body"))
    rest = [c for c in marked.columns if c != "_body"]
    marks = settle(fingerprints(marked, rest, shingle, "_body", "_mark"))
    codes = settle(marks.groupBy(F.col("_mark").alias("fp")).agg(F.min("doc_id").alias("least")))
    stars = connected_components(links(codes, most).withColumn("s", F.lit(0)))
    classes = codes.join(stars.select(F.col("u").alias("fp"), "comp"), "fp", "left").select("fp", F.coalesce("comp", "fp").alias("comp"), "least")
    names = classes.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = settle(classes.join(names, "comp").select("fp", F.col("comp").alias("class_code"), "component_id"))
    return marks.join(named, marks["_mark"] == named["fp"]).select(*rest, F.col("_mark").alias("fingerprint"), "class_code", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, one of each class of ``near_duplicates``: that with the smallest doc_id (null last), then the smallest key of its whole row.

    Texts without words are one class.  Rows that agree in every column count
    once.  Whole rows are shuffled once, by (doc_id, row key), where no group
    of copies meets in one task.
    """
    columns = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{doc_id}`").alias("_id"),
                        F.col(f"`{text}`").alias("_text"), content_key(*[F.col(f"`{c}`") for c in columns]).alias("_key"))
    found = near_duplicates(keyed, shingle, most, "_id", "_text", ["_key"])
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("_kid"), F.col("_key").alias("_kkey"))
    winners = found.groupBy("class_code").agg(F.min(order).alias("w")).select("w._kid", "w._kkey")
    once = keyed.select("row", "_id", "_key").dropDuplicates(["_id", "_key"])
    return once.join(winners, F.col("_id").eqNullSafe(F.col("_kid")) & (F.col("_key") == F.col("_kkey")), "left_semi").select("row.*")
