"""Byte-pair encoding and decoding; merges are found by a segment tree over the ranks of adjacent pairs."""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

#: Words that a worker remembers with their ids before it starts anew; does not change results.
REMEMBERED = 600_000
#: White space as the vocabulary's patterns mean it (fixed values).
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Control characters that Python's split() takes for white space and the patterns do not.
NOT_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Letters and numbers of Unicode 16, which the vocabulary's patterns know and Python 3.13 does not (fixed values).
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
#: Capital and small letters younger than Python 3.13: first capital, last capital, first small (fixed values).
NEW_CASES = [
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x0264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x019B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB)]
#: Combining marks that the vocabulary's NFC, of older tables, leaves where they stand, and one letter that it does not compose (fixed values).
STANDING = [
    (0x07FD, 0x07FD), (0x0898, 0x089F), (0x08CA, 0x08D3), (0x09FE, 0x09FE), (0x0C3C, 0x0C3C), (0x0D3B, 0x0D3C), (0x0EBA, 0x0EBA), (0x1715, 0x1715),
    (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50),
    (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E),
    (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45),
    (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF),
    (0x1E4EC, 0x1E4EF)]
STANDS = re.compile("([" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in STANDING) + "])")
SLICE = 256  # texts that a worker holds at once
NONE = 1 << 30  # rank of a pair that does not merge
TREES = 4096  # words whose trees are worked on at once
LONG = 64  # symbols from which on a word gets a tree of its own


def char_class(kind: str, new: Sequence[tuple[int, int]]) -> str:
    """The characters of a general category (Python's tables and the ranges in ``new``) as the inside of a regex class."""
    ranges, start = [], None
    for cp in range(0x110001):
        inside = cp < 0x110000 and unicodedata.category(chr(cp))[0] == kind
        if inside and start is None:
            start = cp
        elif not inside and start is not None:
            ranges.append((start, cp - 1))
            start = None
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in [*ranges, *new])


def byte_letters() -> list[str]:
    """A printable character for each byte: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def compose(text: str) -> str:
    """NFC as the vocabulary means it: marks that stand are letters of their own, over which nothing moves or joins."""
    if STANDS.search(text) is None:
        return unicodedata.normalize("NFC", text)
    return "".join([unicodedata.normalize("NFC", part) for part in STANDS.split(text)])


class MergeTree:
    """Segment tree over a word's adjacent pairs: a node holds the lowest rank below it, the root leads to the leftmost one.

    A merge changes two pairs and removes one; each is a point update along one
    path to the root.
    """

    def __init__(self, symbols: list[int], merges: dict[int, tuple[int, int]]):
        self.merges, self.symbols = merges, symbols
        n = len(symbols)
        self.left, self.right = list(range(-1, n - 1)), [*range(1, n), -1]
        size = 1
        while size < n:
            size *= 2
        self.size = size
        self.tree = tree = [NONE] * (2 * size)
        for i in range(n - 1):
            found = merges.get(symbols[i] << 20 | symbols[i + 1])
            if found:
                tree[size + i] = found[0]
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a <= b else b

    def put(self, i: int) -> None:
        """Recompute the pair that begins at symbol i, and the path above it."""
        tree, j = self.tree, self.right[i]
        found = self.merges.get(self.symbols[i] << 20 | self.symbols[j]) if j >= 0 and self.symbols[i] >= 0 else None
        k = self.size + i
        tree[k] = found[0] if found else NONE
        while k > 1:
            k >>= 1
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a <= b else b
            if tree[k] == low:
                break
            tree[k] = low

    def run(self) -> list[int]:
        tree, symbols, left, right = self.tree, self.symbols, self.left, self.right
        while tree[1] != NONE:
            k = 1
            while k < self.size:
                k = 2 * k if tree[2 * k] == tree[k] else 2 * k + 1
            i = k - self.size
            j = right[i]
            symbols[i] = self.merges[symbols[i] << 20 | symbols[j]][1]
            symbols[j] = -1
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
            self.put(j)
            self.put(i)
            if left[i] >= 0:
                self.put(left[i])
        return [s for s in symbols if s >= 0]


def run_trees(flat: np.ndarray, lengths: np.ndarray, keys: np.ndarray, ranks: np.ndarray, results: np.ndarray) -> list[bytes]:
    """``MergeTree`` for many short words at once: one tree a row, one merge of every unfinished word a round.

    ``flat`` has the words' symbols one after the other, ``keys`` the packed
    pairs in ascending order, ``ranks`` their ranks and ``results`` the merged
    symbol of each rank.  Returns packed ids.
    """
    n, size = len(lengths), 2
    while size < lengths.max():
        size *= 2
    symbols = np.full((n, size + 1), -1, np.int64)  # the last column stands for "no symbol"
    symbols[:, :size][np.arange(size) < lengths[:, None]] = flat
    left = np.tile(np.append(np.arange(-1, size - 1), size), (n, 1))
    left[:, 0] = size
    right = np.tile(np.append(np.arange(1, size + 1), size), (n, 1))
    right[np.arange(n), lengths - 1] = size

    def rank(a, b):
        pair = np.where((a < 0) | (b < 0), -1, a << 20 | b)
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        return np.where(keys[at] == pair, ranks[at], NONE)

    tree = np.full((n, 2 * size), NONE, np.int64)
    tree[:, size:2 * size - 1] = rank(symbols[:, :size - 1], symbols[:, 1:size])
    level = size
    while level > 1:
        half = level // 2
        tree[:, half:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
        level = half
    rows = np.flatnonzero(tree[:, 1] < NONE)
    while len(rows):
        low = tree[rows, 1]
        k = np.ones(len(rows), np.int64)
        for _ in range(size.bit_length() - 1):  # down from the root: left where the left half has the lowest rank
            k = 2 * k + (tree[rows, 2 * k] != low)
        i = k - size
        j = right[rows, i]
        after, before = right[rows, j], left[rows, i]
        symbols[rows, i], symbols[rows, j] = results[low], -1
        right[rows, i] = after
        left[rows, after] = i
        tree[rows, size + j] = NONE
        tree[rows, size + i] = rank(symbols[rows, i], symbols[rows, after])
        has = before < size
        tree[rows[has], size + before[has]] = rank(symbols[rows[has], before[has]], symbols[rows[has], i[has]])
        for r, leaf in ((rows, j), (rows, i), (rows[has], before[has])):  # point updates
            k = (leaf + size) >> 1
            while k.size and k[0]:
                tree[r, k] = np.minimum(tree[r, 2 * k], tree[r, 2 * k + 1])
                k = k >> 1
        rows = rows[tree[rows, 1] < NONE]
    symbols = symbols[:, :size]
    packed = symbols[symbols >= 0].astype("<u4").tobytes()
    ends = np.cumsum((symbols >= 0).sum(axis=1)) * 4
    return [packed[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]


class Codec:
    """Encoder and decoder of one vocabulary: NFC, white space to one blank, lower case; words split by its pattern; a mark ends each word."""

    def __init__(self, vocabulary: str):
        data = json.loads(vocabulary)
        model = data["model"]
        kinds = lambda part, name: [p["type"] for p in (data.get(part) or {}).get(name, [])]
        if (kinds("normalizer", "normalizers"), kinds("pre_tokenizer", "pretokenizers"), data.get("decoder"), model["type"]) != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], None, "BPE"):
            raise ValueError("this vocabulary normalises, splits or decodes in another way")
        self.ids: dict[str, int] = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.inner = np.array([self.ids[c] for c in letters], np.int64)  # a vocabulary has a token for every byte
        self.last = np.array([self.ids[c + end] for c in letters], np.int64)
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.ids[a] << 20 | self.ids[b]] = (rank, self.ids[a + b])
        order = sorted(self.merges)
        self.keys = np.array(order, np.int64)
        self.ranks = np.array([self.merges[k][0] for k in order], np.int64)
        self.results = np.zeros(len(model["merges"]), np.int64)
        for rank, merged in self.merges.values():
            self.results[rank] = merged
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens = [""] * (max([*self.ids.values(), *self.special.values()]) + 1)
        for t, i in [*self.ids.items(), *self.special.items()]:
            self.tokens[i] = t
        split = next(p for p in data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        split = split.replace(r"\s", SPACE).replace(r"\p{L}", char_class("L", NEW_LETTERS)).replace(r"\p{N}", char_class("N", NEW_NUMBERS))
        self.words = re.compile(split).findall
        self.blanks = re.compile(f"[{SPACE}]+").split
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split
        # One letter at a time, as the vocabulary expects: a final capital sigma is not special.
        self.cases = {ord("Σ"): "σ"} | {a + k: chr(c + k) for a, b, c in NEW_CASES for k in range(b - a + 1)}
        self.odd = re.compile("[" + "".join(map(chr, self.cases)) + "]").search
        self.known: dict[str, bytes] = {}

    def chunks(self, text: str) -> list[str]:
        """The normalised text between white space; no word of the pattern reaches over it."""
        if not text.isascii():
            text = compose(text)
            if self.odd(text):
                text = text.translate(self.cases)
        text = text.lower()
        if any(c in text for c in NOT_SPACE):
            return [c for c in self.blanks(text) if c]
        return text.split()

    def learn(self, chunks: set[str]) -> None:
        """Encode chunks that are not known yet; their new words are encoded together, by the size of their trees."""
        known, words = self.known, self.words
        parts = {c: words(c) for c in chunks}
        new = list({w for ws in parts.values() for w in ws if w not in known})
        raw = [w.encode("utf-8") for w in new]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        codes = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(lengths)
        flat = self.inner[codes]
        flat[ends - 1] = self.last[codes[ends - 1]]
        order = np.argsort(lengths, kind="stable")
        for k in order[(lengths[order] > LONG) | (lengths[order] == 1)].tolist():
            word = flat[ends[k] - lengths[k]:ends[k]].tolist()
            known[new[k]] = array("I", MergeTree(word, self.merges).run() if len(word) > 1 else word).tobytes()
        short = order[(lengths[order] > 1) & (lengths[order] <= LONG)]
        for start in range(0, len(short), TREES):
            part = short[start:start + TREES]
            size = lengths[part]
            at = np.repeat(ends[part] - np.cumsum(size), size) + np.arange(size.sum())
            known.update(zip([new[k] for k in part.tolist()], run_trees(flat[at], size, self.keys, self.ranks, self.results)))
        for c, ws in parts.items():
            if len(ws) != 1 or ws[0] != c:
                known[c] = b"".join([known[w] for w in ws])

    def encode_all(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; strings of special tokens in a text become these tokens."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        pieces: list[list[str | bytes]] = []
        for text in texts:
            if "<|" in text:
                parts: list[str | bytes] = []
                for k, piece in enumerate(self.marks(text)):
                    parts += [array("I", [self.special[piece]]).tobytes()] if k % 2 else self.chunks(piece)
                pieces.append(parts)
            else:
                pieces.append(self.chunks(text))
        self.learn({c for parts in pieces for c in parts if c not in known and isinstance(c, str)})
        return [
            b"".join([c if isinstance(c, bytes) else known[c] for c in parts]) if "<|" in text else b"".join([known[c] for c in parts])
            for text, parts in zip(texts, pieces)]

    def decode(self, ids: bytes) -> str:
        """The tokens' strings with a blank between; ids that are not in the vocabulary are passed over."""
        found = array("I", ids)
        if found and max(found) >= len(self.tokens):
            found = array("I", [i for i in found if i < len(self.tokens)])
        return " ".join(map(self.tokens.__getitem__, found))


def _codec(state: dict) -> Codec:
    """The codec of this worker: made once, kept in the broadcast value for the tasks that follow."""
    if "codec" not in state:
        state["codec"] = Codec(state["json"])
    return state["codec"]


def encode(docs: DataFrame, vocabulary: str, columns: Sequence[str] | None = None, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``columns`` (default: all) and ``ids``, the whole text's token ids as packed little-endian unsigned 32-bit integers.

    ``vocabulary`` is the content of a tokenizer file (a few MB, fixed; it is
    read once on the driver and broadcast).  With ``decoded`` the ids are
    decoded in the same pass into a column of that name.  A null or empty text
    has no ids; columns of the same names are replaced; rows are independent.
    """
    shared = docs.sparkSession.sparkContext.broadcast({"json": vocabulary})
    columns = [c for c in (docs.columns if columns is None else columns) if c not in (ids, decoded)]
    kept = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{text}`").alias("_body"))
    names = [*columns, ids] + ([decoded] if decoded else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                packed = codec.encode_all([t or "" for t in part.column(part.num_columns - 1).to_pylist()])
                out = [*part.columns[:-1], pa.array(packed, pa.binary())]
                if decoded:
                    out.append(pa.array([codec.decode(p) for p in packed], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=names)

    fields = [*kept.schema.fields[:-1], StructField(ids, BinaryType())] + ([StructField(decoded, StringType())] if decoded else [])
    return kept.mapInArrow(run, StructType(fields))


def decode(tokens: DataFrame, vocabulary: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Packed ids (see ``encode``) to text in a column ``text``; null ids give an empty text."""
    shared = tokens.sparkSession.sparkContext.broadcast({"json": vocabulary})
    columns = [c for c in tokens.columns if c != text]
    kept = tokens.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{ids}`").alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                texts = [codec.decode(p.as_py() or b"") for p in part.column(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=[*columns, text])

    return kept.mapInArrow(run, StructType([*kept.schema.fields[:-1], StructField(text, StringType())]))


def token_digests(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, and the SHA-256 of its packed ids and of its decoded text."""
    coded = encode(docs, vocabulary, [doc_id], text, "_ids", "_decoded")
    return coded.select(
        F.col(f"`{doc_id}`").alias("doc_id"), (F.octet_length("_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("_ids", 256).alias("ids_sha256"), F.sha2(F.col("_decoded").cast("binary"), 256).alias("decoded_sha256"))
