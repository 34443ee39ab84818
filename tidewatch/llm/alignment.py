"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text, and how often each pair meets in the corpus."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator, Sequence
from itertools import chain
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from tidewatch.llm.bpe import byte_letters
from tidewatch.session import settle

TEXTS, CHARS = 2048, 1_500_000  # a batch ends at so many texts, or with the text that reaches so many characters
SPACE = "▁"  # a piece's space
#: Splits a text for byte-level merges (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What the quick encoder is not asked for: characters whose class may depend on the Unicode version, and long white space.
UNSURE = re.compile("[\u0180-\U0010ffff]|\\s{512}").search
QUICK_CHARS = 1_000_000


class Tokenizers:
    """Encoder A over a blank and the text, encoder B over the text (it adds the blank itself), and the bytes of their tokens."""

    def __init__(self, byte_json: str, piece_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        from sentencepiece import SentencePieceProcessor
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(byte_json), SentencePieceProcessor(model_proto=piece_model)
        self.a.encode_special_tokens = True  # their strings in a text are text
        self.a.no_truncation()
        self.a.no_padding()
        byte = {c: b for b, c in enumerate(byte_letters())}
        data = json.loads(byte_json)
        entries = {i: bytes(byte[c] for c in t) for t, i in data["model"]["vocab"].items()} | {t["id"]: t["content"].encode() for t in data["added_tokens"]}
        self.a_bytes = [entries.get(i, b"") for i in range(max(entries) + 1)]
        # Merged ids that ascend with their rank are ranks themselves: the same merges from bytes, at a fraction of the time.
        vocab = data["model"]["vocab"]
        made = [vocab["".join(pair if isinstance(pair, list) else pair.split(" "))] for pair in data["model"]["merges"]]
        plain = data["normalizer"] is None and data["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        same = plain and all(a < b for a, b in zip(made, made[1:])) and set(entries) - set(vocab.values()) == {t["id"] for t in data["added_tokens"]}
        self.quick = Encoding("a", pat_str=SPLIT, mergeable_ranks={entries[i]: i for i in vocab.values()}, special_tokens={}).encode_ordinary if same else None
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(SPACE, " ").encode()
        self.b_bytes = [piece(i) for i in range(self.b.get_piece_size())]
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        #: Each id with what may follow it in the written groups: ids with a comma, then ids with a bar, then with a semicolon.
        self.ids = max(len(self.a_bytes), len(self.b_bytes))
        self.written = [f"{i}{mark}" for mark in ",|;" for i in range(self.ids)]

    def encode(self, texts: Sequence[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B; both empty for a text that is null or empty, or whose bytes do not come back."""
        bodies = [" " + (t or "") for t in texts]
        sure = [self.quick is not None and len(t) < QUICK_CHARS and not UNSURE(t) for t in bodies]
        slow = iter(self.a.encode_batch_fast([t for t, s in zip(bodies, sure) if not s], add_special_tokens=False))
        a = [self.quick(t) if s else next(slow).ids for t, s in zip(bodies, sure)]
        b = self.b.encode([t or "" for t in texts], num_threads=1)
        for k, body in enumerate(bodies):
            raw = body.encode()
            if not texts[k] or b"".join(map(self.b_bytes.__getitem__, b[k])) != raw or not (sure[k] or b"".join(map(self.a_bytes.__getitem__, a[k])) == raw):
                a[k], b[k] = [], []
        return a, b


def _side(ids: list[list[int]], sizes: np.ndarray) -> pd.DataFrame:
    """(doc, token, start, end, row) of all tokens of a batch; its texts lie one after the other on one scale of bytes."""
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    token = np.fromiter(chain.from_iterable(ids), np.int64, counts.sum())
    end = np.cumsum(sizes[token])
    return pd.DataFrame({"doc": np.repeat(np.arange(len(ids)), counts), "token": token, "start": end - sizes[token], "end": end, "row": np.arange(len(token))}, copy=False)


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows of A and B whose byte ranges overlap.

    Where two ranges overlap, one begins inside the other: each start looks up
    the token that covers it on the other side, by document; pairs that begin
    together are found from both sides and taken once.
    """
    look = lambda x, y: pd.merge_asof(x[["start", "doc", "row"]], y[["start", "doc", "row"]].assign(begins=y["start"]), on="start", by="doc", suffixes=("", "_over"))
    from_a, from_b = look(a, b), look(b, a)
    inner = from_b[from_b["begins"] != from_b["start"]]
    return (np.concatenate([from_a["row"], inner["row_over"]]).astype(np.int64), np.concatenate([from_a["row_over"], inner["row"]]).astype(np.int64))


def align_batch(coder: Tokenizers, texts: Sequence[str | None]) -> dict[str, Any]:
    """Alignment of a batch of texts; lists and arrays have an entry per text.

    ``slots`` are a text's links as places in ``pairs`` (a, b, n), the distinct
    id pairs of the batch and how many links hold them.
    """
    ids = coder.encode(texts)
    a, b = _side(ids[0], coder.a_sizes), _side(ids[1], coder.b_sizes)
    in_a, in_b = overlaps(a, b)
    doc = a["doc"].to_numpy()[in_a]
    order = np.argsort(doc, kind="stable")
    code = (a["token"].to_numpy()[in_a] << 32 | b["token"].to_numpy()[in_b])[order]
    pairs, slots = np.unique(code, return_inverse=True)
    links = np.bincount(doc, minlength=len(texts))
    slots = slots.astype("<u2" if len(pairs) <= 1 << 16 else "<u4")
    cuts = np.concatenate([[0], np.cumsum(links)])
    # Groups: a token belongs to the first end at or behind its own that both sides share.
    shared = np.intersect1d(a["end"], b["end"], assume_unique=True)
    groups = np.bincount(a["doc"].to_numpy()[np.searchsorted(a["end"], shared)], minlength=len(texts))
    place = np.concatenate([2 * np.searchsorted(shared, a["end"]), 2 * np.searchsorted(shared, b["end"]) + 1])
    last = np.concatenate([np.isin(a["end"], shared), np.isin(b["end"], shared)])
    mark = np.where(last, np.concatenate([np.full(len(a), 1), np.full(len(b), 2)]), 0)
    line = np.argsort(place, kind="stable")
    words = list(map(coder.written.__getitem__, (np.concatenate([a["token"], b["token"]]) + coder.ids * mark)[line].tolist()))
    n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in ids)
    ends = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
    return {
        "n_a": n_a, "n_b": n_b, "n_groups": groups, "n_links": links, "slots": [slots[i:j].tobytes() for i, j in zip(cuts, cuts[1:])],
        "groups": ["".join(words[i:j])[:-1] for i, j in zip(ends, ends[1:])], "a_ids": ids[0], "b_ids": ids[1],
        "pairs": (pairs >> 32, pairs & 0xFFFFFFFF, np.bincount(slots, minlength=len(pairs)))}


PAIRS = ArrayType(StructType([StructField("a", IntegerType()), StructField("b", IntegerType()), StructField("n", LongType())]))
#: What a document can carry out of ``align_tokens`` beside its counts.
SHOWN = {"groups": StringType(), "groups_sha256": StringType(), "a_ids": ArrayType(IntegerType()), "b_ids": ArrayType(IntegerType())}


def align_tokens(docs: DataFrame, byte_json: str, piece_model: bytes, show: Sequence[str] = ("groups_sha256",), text: str = "text") -> DataFrame:
    """(row, n_a, n_b, n_groups, n_links, *show, slots, batch, pairs): one row per document, settled.

    ``row`` is the document without its text.  ``show`` chooses among the written
    groups, their SHA-256 ('' without tokens) and the ids.  ``slots`` are the
    links as unsigned little-endian numbers (two bytes or four), places in the
    pairs of the ``batch``; these stand with the batch's first document, null
    with the others.  A batch is a run of texts that a worker aligns together
    (TEXTS, CHARS: whole texts, a longer one alone).  Vocabularies are read on
    the driver and broadcast (a few MB, fixed).  Texts that are null, empty, or
    not given back by both tokenizers have no tokens; repeated rows are
    documents of their own.
    """
    shared = docs.sparkSession.sparkContext.broadcast({"files": (byte_json, piece_model)})
    own = [F.col(f"`{c}`") for c in docs.columns if c != text] or [F.lit(None).cast("int").alias("_none")]
    packed = docs.select(F.struct(*own).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    counts = ["n_a", "n_b", "n_groups", "n_links"]
    schema = StructType([
        packed.schema["row"], *[StructField(c, LongType()) for c in counts], *[StructField(c, SHOWN[c]) for c in show],
        StructField("slots", BinaryType()), StructField("batch", LongType()), StructField("pairs", PAIRS)])
    kinds = {"groups": pa.string(), "groups_sha256": pa.string(), "a_ids": pa.list_(pa.int32()), "b_ids": pa.list_(pa.int32())}
    pair = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = shared.value
        if "coder" not in state:  # kept in the broadcast value for this worker's next tasks
            state["coder"] = Tokenizers(*state["files"])
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                texts, chars = [], 0
                while start + len(texts) < batch.num_rows and len(texts) < TEXTS and chars < CHARS:
                    texts.append(batch.column(1)[start + len(texts)].as_py())
                    chars += len(texts[-1] or "")
                made = align_batch(state["coder"], texts)
                if "groups_sha256" in show:
                    made["groups_sha256"] = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in made["groups"]]
                size = len(texts)
                first = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(made["pairs"], pair)], fields=list(pair))
                lists = pa.ListArray.from_arrays(pa.array([0] + [len(first)] * size, pa.int32()), first, mask=pa.array([k > 0 for k in range(size)]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, size), *[pa.array(made[c], pa.int64()) for c in counts], *[pa.array(made[c], kinds[c]) for c in show],
                     pa.array(made["slots"], pa.binary()), pa.array([number] * size, pa.int64()), lists], names=schema.names)
                start, number = start + size, number + 1

    return settle(packed.mapInArrow(run, schema))


def count_pairs(aligned: DataFrame) -> DataFrame:
    """(a, b, n, best): links that hold a pair of ids in the whole corpus, and whether no pair of its B id has more.

    Each batch brings a pair once with its own count, so a pair that occurs
    everywhere is as many rows as there are batches.
    """
    counted = aligned.filter(F.col("pairs").isNotNull()).select(F.inline("pairs")).groupBy("a", "b").agg(F.sum("n").alias("n"))
    counted = settle(counted)
    top = counted.groupBy(F.col("b").alias("_b")).agg(F.max("n").alias("_most"))
    return counted.join(top, F.col("b") == F.col("_b")).select("a", "b", "n", (F.col("n") == F.col("_most")).alias("best"))


def rate_links(aligned: DataFrame) -> DataFrame:
    """The documents of ``align_tokens`` with n_best (links whose pair is its B id's most frequent, ties too) and count_sum (corpus counts of all links).

    A batch asks for each of its pairs once; the counts come back to its
    documents by batch.  A task holds one batch and its pairs at a time.
    """
    rated = count_pairs(aligned)
    asked = aligned.filter(F.col("pairs").isNotNull()).select("batch", F.posexplode("pairs")).select("batch", F.col("pos").alias("slot"), "col.a", "col.b")
    answers = asked.join(rated, ["a", "b"]).select("batch", "slot", "n", "best")
    kept = [c for c in aligned.columns if c not in ("slots", "batch", "pairs")]
    schema = StructType([aligned.schema[c] for c in kept] + [StructField("n_best", LongType()), StructField("count_sum", LongType())])

    def rate(docs: pa.Table, got: pa.Table) -> pa.Table:
        slot = got.column("slot").to_numpy()
        n, best = np.zeros(len(slot), np.int64), np.zeros(len(slot), np.int64)
        n[slot], best[slot] = got.column("n").to_numpy(), got.column("best").to_numpy(zero_copy_only=False)
        sums = []
        for packed, links in zip(docs.column("slots").to_pylist(), docs.column("n_links").to_pylist()):
            at = np.frombuffer(packed, f"<u{len(packed) // links}") if links else np.zeros(0, np.int64)
            sums.append((int(best[at].sum()), int(n[at].sum())))
        out = docs.select(kept)
        for k, name in enumerate(("n_best", "count_sum")):
            out = out.append_column(name, pa.array([s[k] for s in sums], pa.int64()))
        return out

    plain = aligned.select(*kept, "slots", F.col("batch").alias("of"))
    return plain.groupBy("of").cogroup(answers.groupBy("batch")).applyInArrow(rate, schema)
