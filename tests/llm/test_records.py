"""Merkle manifest, chat formatting and token alignment against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from conftest_llm import prose
from pyspark.sql import functions as F

from tidewatch.llm import alignment, chats, merkle
from tidewatch.llm.queries import PROBE, byte_vocabulary, pieces


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# --- Merkle manifest -------------------------------------------------------


def brute_leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_root(nodes):
    """Root and, for each leaf, its siblings in order."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, i in zip(proofs, at):
            p += [nodes[i ^ 1]] if i ^ 1 < len(nodes) else []
        nodes, at = [sha("".join(nodes[k:k + 2])) for k in range(0, len(nodes), 2)], [i // 2 for i in at]
    return nodes[0], proofs


def brute_manifest(rows):
    """Counter of (doc_id, leaf, subroot, root, siblings) over rows of (doc_id, lang, leaf)."""
    trees = {}
    for doc_id, lang, leaf in rows:
        trees.setdefault(lang, []).append((doc_id is not None, doc_id, leaf))
    order = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    made = {}
    for g in order:
        trees[g].sort(key=lambda r: (r[0], r[1] or 0, r[2]))
        made[g] = brute_root([r[2] for r in trees[g]])
    root, above = brute_root([made[g][0] for g in order])
    return Counter((r[1], r[2], made[g][0], root, tuple(made[g][1][k] + above[j])) for j, g in enumerate(order) for k, r in enumerate(trees[g]))


def proved(docs):
    leaf = merkle.leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    rows = merkle.prove_rows(merkle.build_manifest(docs, leaf, carry=[F.col("doc_id")]))
    return rows.select("row.doc_id", "leaf", "subroot", "root", merkle.siblings(F.col("steps")).alias("s"), merkle.fold(F.col("leaf"), F.col("steps")).alias("folded"))


def check_manifest(docs):
    want = brute_manifest([(r.doc_id, r.lang, brute_leaf(r.doc_id, r.source, r.lang, r.n_chars, r.text)) for r in docs.collect()])
    got = proved(docs).collect()
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, tuple(r.s)) for r in got) == want
    assert all(r.folded == r.root for r in got)


def test_manifest_edges(edge, nothing):
    check_manifest(edge)
    assert proved(nothing).count() == 0


@pytest.mark.parametrize("step", [1, 2, 3])
def test_manifest_of_many_rounds(spark, monkeypatch, step):
    """Small steps make many leaf partitions, rounds and copies of asked nodes out of few rows."""
    monkeypatch.setattr(merkle, "STEP", step)
    monkeypatch.setattr(merkle, "ASKERS", 1)
    rows = [(k, ["a", None, "é", "zz"][k % 4] if k > 150 else "hot", "s", k, f"t{k}") for k in range(230)]
    check_manifest(spark.createDataFrame(rows, "doc_id long, lang string, source string, n_chars long, text string"))


@pytest.mark.parametrize("langs", [1, 2, 37])
def test_manifest_of_many_groups(spark, langs):
    rows = [(k, f"l{k % langs}", None, None, None) for k in range(90)]
    check_manifest(spark.createDataFrame(rows, "doc_id long, lang string, source string, n_chars long, text string"))


def test_octopus_lists_least():
    """Proofs of any subset come out of the listed nodes alone; none of them is known or follows from known ones."""
    rng = random.Random(5)
    for n in (1, 2, 3, 7, 8, 33, 100):
        leaves = [sha(str(k)) for k in range(n)]
        levels = merkle.climb(leaves, (n - 1).bit_length())
        root, proofs = brute_root(leaves)
        assert levels[-1] == [root]
        for _ in range(20):
            held = rng.sample(range(n), rng.randint(1, n))
            lacks = merkle.missing_nodes(held, n)
            assert len(set(lacks)) == len(lacks)
            assert not any(k >> level == i for level, i in lacks for k in held)
            got = merkle.expand_proofs({k: leaves[k] for k in held}, n, {(level, i): levels[level][i] for level, i in lacks})
            assert {k: [d for _, d in s if d] for k, s in got.items()} == {k: proofs[k] for k in held}


def test_tampered_rows_fail(spark):
    from tidewatch.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    lengths = {r.doc_id: r.n_chars for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op11_merkle_manifest"](spark, sf).collect():
        chosen = zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and lengths[r.doc_id] is not None
        assert r.verified == (not chosen) and (r.folded_root == r.root) == r.verified


# --- Chats -----------------------------------------------------------------


def hard_text(rng):
    bits = [*chats.CONTROL, "\\", "\\\\", "<", "|", ">", "im_end", "[", "/", "\n", "$1", "é", "\U0001F600", " ", "a"]
    return "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))


def test_chats_come_back(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(6)]), rng.choice([None, "user", "assistant", "system", "assistant", "<|im_sep|>x\\"]), rng.choice([None, hard_text(rng), hard_text(rng)]), "x") for _ in range(600)]
    rows += [(7, 1, "user", "same", "x")] * 4 + [(8, k, "assistant", f"long {k} " * 50, "x") for k in range(500)] + [(9, 0, "user", prose(1, 20000), "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, row string").withColumn("formatted", F.lit("clash"))
    made = chats.format_chats(turns)
    back = made.select("conv_id", "formatted", "loss_mask", chats.read_turns(F.col("formatted")).alias("turns"), chats.read_trained(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()
    want = {}
    for conv, turn, role, text, _ in rows:
        want.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert {r.conv_id for r in back} == set(want) and len(back) == len(want)
    for r in back:
        said = [t[2:] for t in sorted(want[r.conv_id], key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))]
        assert [(t.role, t.text) for t in r.turns] == said
        assert r.loss == [t for role, t in said if role == "assistant"]
        blocks = sum(k == 0 or said[k - 1][0] != s[0] for k, s in enumerate(said))
        marks = Counter(re.findall("|".join(map(re.escape, chats.CONTROL)), r.formatted))
        assert marks == +Counter({chats.START: blocks, chats.SEP: blocks, chats.END: blocks, chats.PART: len(said) - blocks})


def test_chats_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chats.format_chats(none).count() == 0


def test_probe_is_escaped(spark):
    turns = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    r = chats.format_chats(turns).first()
    body = "<\\/s>[\\INST] ok [\\/INST]"
    assert r.formatted == f"<|im_start|>user<|im_sep|>{body}<|im_end|><|im_start|>assistant<|im_sep|>{body}<|im_end|>"
    assert r.loss_mask == [False, False, False, False, False, True, False]


# --- Token alignment -------------------------------------------------------


def brute_alignment(rows, coder):
    """Per row (n_a, n_b, n_groups, n_links, n_best, count_sum, groups) by comparing byte ranges token by token."""
    ids = [coder.encode([t]) for t in rows]
    made, total = [], Counter()
    for (a,), (b,) in ids:
        spans = []
        for tokens, sizes in ((a, coder.a_sizes), (b, coder.b_sizes)):
            at, side = 0, []
            for t in tokens:
                side.append((t, at, at + int(sizes[t])))
                at += int(sizes[t])
            spans.append(side)
        links = [(x[0], y[0]) for x in spans[0] for y in spans[1] if x[1] < y[2] and y[1] < x[2]]
        ends = sorted({x[2] for x in spans[0]} & {y[2] for y in spans[1]})
        groups = [[[str(t) for t, s, e in side if lo <= s and e <= hi] for side in spans] for lo, hi in zip([0, *ends], ends)]
        made.append((len(a), len(b), links, len(ends), ";".join(",".join(x) + "|" + ",".join(y) for x, y in groups)))
        total.update(links)
    best = {}
    for (_, y), n in total.items():
        best[y] = max(best.get(y, 0), n)
    return [(n_a, n_b, n, len(links), sum(total[k] == best[k[1]] for k in links), sum(total[k] for k in links), groups) for n_a, n_b, links, n, groups in made]


@pytest.fixture(scope="module")
def coder():
    return alignment.Tokenizers(byte_vocabulary(), pieces())


def check_alignment(spark, coder, texts):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, slots string").repartition(3)
    rated = alignment.rate_links(alignment.align_tokens(docs, byte_vocabulary(), pieces(), show=("groups", "groups_sha256", "a_ids")))
    got = {r.doc_id: r for r in rated.select("row.doc_id", "row.slots", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "groups_sha256", "a_ids").collect()}
    assert len(got) == len(texts)
    for k, want in enumerate(brute_alignment(texts, coder)):
        r = got[k]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) == want
        assert r.groups_sha256 == (sha(r.groups) if r.groups else "") and len(r.a_ids) == r.n_a


def test_alignment_equals_brute_force(spark, coder, edge):
    odd = [None, "", " ", "\n\n x", "a▁b", "<s> </s><|endoftext|>", "日本語 ünïcode \U0001F600\U0001F468‍\U0001F469", "é\x00ż", "ﬁ ² Å", "  two  spaces ", "\t", prose(5, 300), "b" * 3000]
    check_alignment(spark, coder, odd + [prose(k, 40) for k in range(60)] + [prose(1, 40)] * 5 + [r.text for r in edge.collect() if r.text is None or len(r.text) < 5000])


def test_alignment_over_small_batches(spark, coder, monkeypatch):
    """Every document a batch or two: counts still come from the whole corpus."""
    monkeypatch.setattr(alignment, "TEXTS", 2)
    check_alignment(spark, coder, [prose(k % 7, 30) for k in range(25)] + [None, ""])


def test_alignment_of_nothing(spark, nothing):
    assert alignment.rate_links(alignment.align_tokens(nothing, byte_vocabulary(), pieces())).count() == 0


def test_texts_that_do_not_come_back(coder):
    assert coder.encode(["a▁b", None, ""]) == ([[], [], []], [[], [], []])
    a, b = coder.encode([" x"])
    assert b"".join(coder.a_bytes[i] for i in a[0]) == b"  x" == b"".join(coder.b_bytes[i] for i in b[0])


def test_quick_encoder_equals_the_library(coder):
    assert coder.quick is not None
    rng = random.Random(9)
    singles = [chr(c) for c in range(0x180)]
    texts = singles + [f"a{c} {c}1{c}" for c in singles] + ["".join(rng.choice(singles + [" ", " ", "a", "'s", "'LL", "1"]) for _ in range(rng.randint(1, 60))) for _ in range(4000)]
    texts += ["<|endoftext|>", " " * 500 + "x", "\n" * 510, "ab" * 5000, prose(4, 5000)]
    assert not any(alignment.UNSURE(" " + t) for t in texts)
    want = [e.ids for e in coder.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
    assert [coder.quick(" " + t) for t in texts] == want
    assert alignment.UNSURE("ƀ") and alignment.UNSURE(" " * 512) and alignment.UNSURE("a\U0001F600")
