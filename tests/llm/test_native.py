"""Mixing, sharding, quality rules and line deduplication against plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest
from conftest_llm import prose
from oracle import compare, connect, duck_rows, spark_rows

from tidewatch.llm import linededup, mixing, quality, sharding
from tidewatch.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark_rows(QUERIES[name](spark, SF)), duck_rows(connect(SF), ORACLES[name])) == ""


def test_targets_stop_and_share(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), (None, 0)], "source string, size long")
    got = {r.source: r for r in mixing.set_targets(mixing.cycle_weights(sizes)).collect()}
    assert [got[s].weight for s in ("a", "b", "c", None)] == [5.0, 2.0, 1.0, 5.0]
    assert got["a"].target == 200 and got["c"].target == 20 and got[None].target == 0
    assert abs(sum(r.target for r in got.values()) - 1.5 * 1110) < 1e-9


def test_mix_edges(edge, nothing):
    targets = mixing.set_targets(mixing.cycle_weights(mixing.source_sizes(edge)))
    plan = mixing.plan_mix(edge, targets)
    rows = plan.select("row.doc_id", "row.size", "size", "copies").collect()
    assert len(rows) == 15 and all(0 <= r.copies <= 2 for r in rows)
    mixed = mixing.mix(edge, targets)
    assert mixed.columns == edge.columns and mixed.count() == sum(r.copies for r in rows)
    assert Counter(map(str, mixed.collect())) == Counter(map(str, mixing.mix(edge, targets).collect()))
    assert mixing.mix(nothing, mixing.set_targets(mixing.cycle_weights(mixing.source_sizes(nothing)))).count() == 0


def test_mix_near_target(spark):
    docs = spark.createDataFrame([(i, prose(i, 20), "s" + str(i % 4)) for i in range(2000)], "doc_id long, text string, source string")
    rows = mixing.plan_mix(docs, mixing.set_targets(mixing.cycle_weights(mixing.source_sizes(docs)))).selectExpr("row.source s", "size * copies taken", "target").collect()
    taken = Counter()
    for r in rows:
        taken[r.s] += r.taken
    for r in rows:
        assert abs(taken[r.s] - r.target) < 0.12 * r.target


@pytest.mark.parametrize("shards", [1, 3, 8, 40])
def test_shards(edge, nothing, shards):
    rows = sharding.assign_shards(edge, shards).collect()
    assert len(rows) == 15
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    total, most = sum(r.size for r in rows), max(r.size for r in rows)
    for s in slots:
        assert sum(r.size for r in rows if r.shard == s) <= total / shards + 2 * most
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    text = edge.filter("doc_id = 9").first().text.encode()
    assert by_id[9].text_crc32 == zlib.crc32(text) and by_id[9].size == len(text) + 1 and by_id[0].size == 1
    assert sharding.assign_shards(nothing, shards).count() == 0


def test_shards_keep_equal_texts_together(spark):
    docs = spark.createDataFrame([(i, prose(i // 5, 10)) for i in range(1000)], "doc_id long, text string")
    homes = {}
    rows = sharding.assign_shards(docs, 8).collect()
    for r in rows:
        homes.setdefault(r.digest, set()).add(r.shard)
    split = sum(len(h) > 1 for h in homes.values())
    assert split <= 7
    most = max(r.size for r in rows)
    sums = Counter()
    for r in rows:
        sums[r.shard] += r.size
    assert max(sums.values()) - min(sums.values()) <= 4 * most


def test_write_shards(spark, edge, tmp_path):
    sharding.write_shards(edge, f"file://{tmp_path}/out", 3)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == 15
    want = Counter(r.shard for r in sharding.assign_shards(edge, 3).collect())
    assert Counter(r.shard for r in back.collect()) == want


def brute_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = {}
    for i in range(len(w) - 4):
        grams.setdefault(tuple(w[i:i + 5]), []).append(i)
    covered = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_counts(edge, nothing):
    got = quality.judge_quality(edge)
    assert set(edge.columns) <= set(got.columns)
    for r in got.collect():
        want = brute_counts(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality.judge_quality(nothing).count() == 0


def test_quality_overlapping_windows(spark):
    texts = ["a a a a a a", "a b c d e x a b c d e f a b c d e", "x y " * 4, "q " * 5 + "r"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    for r in quality.judge_quality(docs).collect():
        assert r.n_repeat_words == brute_counts(r.text)[4]


def test_marks_are_guaranteed(spark):
    """Equal runs of enough words hold equal marks at equal places, whatever stands around them."""
    run = prose(70, 50)
    texts = spark.createDataFrame([(1, 0, f"x {run} y"), (2, 0, f"{prose(1, 30)}\nz z {run}"), (3, 0, prose(70, 49))], "_id long, _key long, _text string")
    found = {r._id: {(m.at, m.mark) for m in r.marks} for r in linededup.winnow(texts).collect()}
    assert {(at - 1, mark) for at, mark in found[1]} & {(at - 32, mark) for at, mark in found[2]} and not found[3]
    assert [linededup.window_shape(n) for n in (1, 2, 5, 50)] == [(1, 1), (2, 1), (3, 3), (26, 25)]


def test_words_of_copies_are_cut_after_the_join(spark):
    """The words of all texts were once cut to find those of the few copies."""
    rows = [(i, prose(i % 4, 60)) for i in range(6)]
    keyed = spark.createDataFrame(rows, "_id long, _text string").selectExpr("_id", "xxhash64(_text) _key", "xxhash64(7, _text) _key2", "_text")
    texts, copies = linededup._by_text(keyed, 50)
    plan = copies._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" in plan and "split(" not in plan[plan.index(":- "):]  # from the join's first side on
    assert sorted(r._id for r in texts.collect()) == [0, 1, 2, 3] and sorted((r._id, r._n) for r in copies.collect()) == [(4, 60), (5, 60)]


def brute_passages(rows, least=50):
    """Every pair of places is compared; each maximal equal run of enough words cuts its later place."""
    docs = sorted({(d is None, d or 0, t) for d, t in rows if t is not None})
    every, out = [re.findall(r"[^\x20\x09-\x0D]+", t) for _, _, t in docs], {}
    for k, doc in enumerate(docs):
        mine, cut = every[k], set()
        for e in range(k + 1):
            other = every[e]
            for shift in range(-len(mine) + 1, len(other) if e < k else 0):
                run = []
                for j in range(max(0, -shift), min(len(mine), len(other) - shift) + 1):
                    if j < min(len(mine), len(other) - shift) and mine[j] == other[j + shift]:
                        run.append(j)
                        continue
                    if len(run) >= least:
                        cut |= set(run)
                    run = []
        out[doc] = "".join(p for j, p in enumerate(re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", doc[2])) if j not in cut)
    return out


def test_passages_equal_brute_force(spark, edge, nothing):
    """Passages go whole: lines behind the last full window, and what begins and ends within a line; not 49 words."""
    a, b = [prose(60 + k, n) for k, n in enumerate((30, 30, 10))], [prose(70, 60), prose(71, 20)]
    rows = [(101, "\n".join(a)), (102, "\n".join(["x y", *a, "own words"])), (103, "\n".join(b)), (104, "\n".join([*b, "", "z"])), (105, "\n".join([*a[1:], *b[1:]]))]
    shared = [prose(50 + k, 12) for k in range(9)]
    rows += [(110 + i, "\n".join([prose(900 + i, 5), *shared[i % 4:9 - i % 3], "", prose(2000 + i, 9)])) for i in range(20)]
    inside, short = prose(80, 50), prose(81, 49)
    rows += [(140 + i, f"{prose(700 + i, 90)} {inside} {prose(740 + i, 80)}\n{prose(780 + i, 9)} {short} {prose(790 + i, 5)}") for i in range(2)]
    rows += [(150, "same " * 120), (151, "q " + "same " * 60 + "r "), (152, "\t" + inside), (152, "\t" + inside), (153, short)]
    rows += [(r.doc_id, r.text) for r in edge.collect() if len(r.text or "") < 10_000]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_passages(rows)
    got = linededup.dedup_passages(docs).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((d, None if t is None else want[(d is None, d or 0, t)]) for d, t in rows)
    found = {r.doc_id: r.text for r in got}
    assert found[102] == "x y\nown words" and found[104] == "\n\nz" and found[105] == rows[4][1]
    assert found[141] == rows[26][1].replace(f" {inside}", "") and found[150] == "same " and found[152] == "" and found[153] == short
    assert linededup.dedup_passages(edge).columns == [*edge.columns, "removed_words"]
    assert linededup.dedup_passages(nothing).count() == 0


@pytest.mark.parametrize("least", [3, 7, 12])
def test_variants_of_passages_equal_brute_force(spark, least):
    """Few words and many near copies: marks at many places whose first place is not the one that matches."""
    rng = random.Random(least)
    pool = [[rng.choice("abcd") + str(rng.randrange(3)) for _ in range(40)] for _ in range(4)]
    rows = []
    for i in range(120):
        made = []
        while len(made) < 40:
            part = rng.choice(pool)
            at = rng.randrange(30)
            made += part[at:at + rng.randrange(2, 3 * least)] if rng.random() < 0.8 else [f"u{rng.randrange(9)}"]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(made) + rng.choice(["", "\n"])))
    rows += [(200 + i, rows[i % 3][1]) for i in range(9)]
    want = brute_passages(rows, least)
    got = linededup.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string"), min_words=least)
    assert {r.doc_id: r.text for r in got.collect()} == {d: want[(False, d, t)] for d, t in rows}


def test_mix_repeated_rows(spark):
    """Rows that agree share a draw and not a fate: together they take what is due to them."""
    rows = [(None, "a", prose(1, 7))] * 1000 + [(None, None, prose(2, 7))] * 400 + [(i, "b", prose(i, 12)) for i in range(900)] + [(7, "c", "one two")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    targets = mixing.set_targets(mixing.cycle_weights(mixing.source_sizes(docs)), share=0.6)
    plan = lambda d, seed: mixing.plan_mix(d, targets, seed).selectExpr("row.source s", "size", "copies", "target").collect()
    for seed in (17, 18, 19):
        got, taken = plan(docs, seed), Counter()
        assert len(got) == len(rows)
        for r in got:
            taken[r.s] += r.size * r.copies
        for r in got:
            assert abs(taken[r.s] - r.target) < (r.size if r.s != "b" else 0.12 * r.target)
        assert Counter(got) == Counter(plan(docs.repartition(5), seed))
