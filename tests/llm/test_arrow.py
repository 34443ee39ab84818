"""SimHash, tokens, vectors, licences, toxicity, addresses and the pipeline against plain Python."""

import hashlib
import json
import math
import re
import textwrap
import unicodedata
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest_llm import prose

from tidewatch.llm import bpe, lattice, licenses, simhash, toxicity, urls
from tidewatch.llm.queries import QUERIES, vocabulary

SF = "/root/testdata/sf0.001"


def classes(n, links):
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    grams = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(spark, edge, nothing):
    base = prose(5, 120).split()
    near = [(100 + k, " ".join([*base[:k], "CHANGED", *base[k + 1:]])) for k in range(60)]
    docs = edge.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    rows = docs.collect()
    marks = [brute_fingerprint(r.text) for r in rows]
    comp = classes(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (marks[i] ^ marks[j]).bit_count() <= 2])
    least = {}
    for r, c in zip(rows, comp):
        if r.doc_id is not None:
            least[c] = min(least.get(c, r.doc_id), r.doc_id)
    want = Counter((r.doc_id, m, least.get(c)) for r, m, c in zip(rows, marks, comp))
    got = simhash.near_duplicates(docs, shingle=3, most=2).collect()
    assert Counter((r.doc_id, r.fingerprint % 2**64, r.component_id) for r in got) == want
    assert simhash.near_duplicates(nothing).count() == 0


def test_index_finds_all_links(spark):
    """Many blocks, several tree levels, dense spots: links must connect what brute force connects."""
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 2**63, 6000, dtype=np.int64)
    codes[3000:5000] = codes[:2000] ^ (np.int64(1) << rng.integers(0, 62, 2000)) ^ (np.int64(1) << rng.integers(0, 62, 2000))
    codes[5000:] = codes[0] ^ (np.int64(1) << rng.integers(0, 62, 1000)) ^ (np.int64(1) << rng.integers(0, 62, 1000))
    codes = np.unique(codes)
    at = {int(c): i for i, c in enumerate(codes)}
    found = simhash.links(spark.createDataFrame([(int(c),) for c in codes], "fp long"), 2).collect()
    pairs = np.argwhere(np.triu(np.bitwise_count((codes[:, None] ^ codes[None, :]).view(np.uint64)) <= 2, 1))
    want = {tuple(p) for p in pairs.tolist()}
    got = [(at[r.u], at[r.v]) for r in found]
    assert all((min(p), max(p)) in want for p in got)
    assert classes(len(codes), got) == classes(len(codes), want)


def test_first_of_each_class_stays(spark):
    """The documents that stay are the first of each class that brute force connects."""
    rows = []
    for k in range(40):
        words = prose(300 + k, 400).split()
        rows += [(10 * k + 2, " ".join(words)), (10 * k + 1, " ".join([*words[:100], "new", *words[101:]])), (10 * k, " ".join(words).upper() + "\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = [brute_fingerprint(t) for _, t in rows]
    comp = classes(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (marks[i] ^ marks[j]).bit_count() <= 2])
    least = {}
    for (k, _), c in zip(rows, comp):
        least[c] = min(least.get(c, k), k)
    kept = sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect())
    assert kept == sorted(least.values()) and len(kept) < 80


def test_classes_without_ids_stay_apart(spark):
    docs = spark.createDataFrame([(None, prose(1, 60)), (None, prose(2, 60)), (None, prose(2, 60) + " "), (None, None), (7, "")], "doc_id long, text string")
    kept = simhash.drop_near_duplicates(docs).collect()
    assert sorted(" ".join((r.text or "").split()) for r in kept) == sorted(["", prose(1, 60), prose(2, 60)])


def test_one_of_each_class_stays(edge, nothing):
    kept = simhash.drop_near_duplicates(edge)
    rows = kept.collect()
    assert kept.columns == edge.columns
    texts = [r.text for r in rows]
    assert sum(not (t or "").strip() for t in texts) == 1 and len(set(texts)) == len(texts)
    assert {r.doc_id for r in rows} >= {0, 3, 4}
    assert simhash.drop_near_duplicates(nothing).count() == 0


@pytest.fixture(scope="module")
def reference():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


ODD = ["", " ", "I'Ll don'T 'sSs <|endoftext|>hi<|startoftext|> <|endoftext", "ΣΑΣ ΟΔΟΣ σας İstanbul ǅ", "é ạ̀ ﬁ ẞ", "x" * 3000 + " " + "ab" * 1500,
       "\x1c\x1d a\x85b\xa0c\u180ed\u200be\u3000f", "٣٤ ½ Ⅷ ²", "👩‍👩‍👧 \U0001F600!!", "\x00\x01", "日本語 テスト 漢字１２", "<|x|>", "thanedble, thanedble. THANEDBLE!!"]


def test_tokens_equal_library(reference):
    codec = bpe.Codec(vocabulary())
    texts = [*ODD, *[prose(k, 50) for k in range(50)]]
    for text, ids in zip(texts, codec.encode_all(texts)):
        want = reference.encode(text, add_special_tokens=False)
        assert np.frombuffer(ids, "<u4").tolist() == want.ids
        assert codec.decode(ids) == reference.decode(want.ids, skip_special_tokens=False)


def test_marks_equal_library(reference):
    """Each combining mark among others, as the library orders and joins them, and strings of any code points."""
    codec, rng = bpe.Codec(vocabulary()), np.random.default_rng(5)
    marks = [chr(c) for c in range(0x110000) if unicodedata.combining(chr(c))] + ["\U00011930", "\u1161", "\u11a8"]
    texts = [a + x + b for x in marks for a, b in (("\u00e1", ""), ("a", "\u0316"), ("q\u0345", "\u0334z"), ("\U00011935", "\u0301"), ("\u1100", "\u0338"))]
    points = [c for c in range(0x3000) if c > 0x20] + [ord(x) for x in marks] + list(range(0x10000, 0x12000))
    texts += ["".join(map(chr, rng.choice(points, 12))) for _ in range(5000)] + ["e" + "".join(rng.choice(marks, 6)) for _ in range(5000)]
    wrong = [t for t, ids in zip(texts, codec.encode_all(texts)) if np.frombuffer(ids, "<u4").tolist() != reference.encode(t, add_special_tokens=False).ids]
    assert not wrong


def test_other_vocabularies_are_refused():
    data = json.loads(vocabulary())
    data["normalizer"]["normalizers"][0]["type"] = "NFKC"
    with pytest.raises(ValueError):
        bpe.Codec(json.dumps(data))


def test_trees_agree():
    codec = bpe.Codec(vocabulary())
    words = [w for k in range(30) for w in prose(k, 20).split()] + ["aaaaaaaaaaaaaaaa", "ababababab", "q"]
    packed = codec.encode_all(words)
    for word, ids in zip(words, packed):
        out = []
        for part in codec.words(word):
            raw = part.encode()
            out += bpe.MergeTree([*codec.inner[list(raw[:-1])].tolist(), int(codec.last[raw[-1]])], codec.merges).run()
        assert np.frombuffer(ids, "<u4").tolist() == out


def test_token_query(spark, edge, nothing, reference):
    docs = edge.select("doc_id", "text", "ids")
    got = Counter(map(tuple, bpe.token_digests(docs, vocabulary()).collect()))
    want = Counter()
    for r in docs.collect():
        e = reference.encode(r.text or "", add_special_tokens=False)
        text = reference.decode(e.ids, skip_special_tokens=False)
        want[r.doc_id, len(e.ids), hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert got == want
    coded = bpe.encode(docs, vocabulary())
    assert coded.columns == ["doc_id", "text", "ids"] and bpe.decode(coded, vocabulary()).count() == docs.count()
    assert bpe.encode(nothing, vocabulary()).count() == 0


def test_lattice_points():
    rng = np.random.default_rng(0)
    y = rng.normal(size=(500, 8)) * 3
    point, roots = lattice.nearest_point(y), lattice.minimal_vectors()
    assert len(roots) == 240 and np.allclose((roots**2).sum(1), 2)
    doubled = 2 * point
    assert np.allclose(doubled, np.rint(doubled)) and np.all((point.sum(1) % 2) == 0)
    own = ((y - point) ** 2).sum(1)
    assert np.all(own[:, None] <= ((y[:, None] - point[:, None] - roots[None]) ** 2).sum(2) + 1e-9)


def test_vectors_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 16))
    rows = []
    for k in range(400):
        v = base[k % 30] + rng.normal(size=16) * (0.03 if k % 3 else 0.5)
        rows.append((k, v.tolist(), k % 2))
    rows += [(400 + k, base[0].tolist(), 0) for k in range(60)]  # a hot vector
    rows += [(500, None, 0), (501, [0.0] * 16, 0), (502, [math.nan] + [1.0] * 15, 0), (503, [math.inf] + [1.0] * 15, 0), (504, base[0].tolist(), None), (505, [], 1),
             (506, (base[0] * 1e200).tolist(), 0), (507, base[0].tolist()[:8], 0), (508, [None] + [1.0] * 15, 0)]
    monkeypatch.setattr(lattice, "TILE", 40)
    got = {r.vec_id: r for r in lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS node", "2 AS cell")).collect()}
    assert len(got) == len(rows)
    ok = [i for i, (k, v, label) in enumerate(rows) if label is not None and v and None not in v and np.all(np.isfinite(v)) and any(v)]
    unit = {i: np.array(rows[i][1]) / np.abs(rows[i][1]).max() for i in ok}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    links = [(i, j) for i in ok for j in ok if i < j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98]
    degree = Counter(i for p in links for i in p)
    comp = classes(len(rows), links)
    wrong = [k for i, (k, _, _) in enumerate(rows) if (got[k].n_links, got[k].component_id, got[k].kept) != (degree[i], rows[comp[i]][0], comp[i] == i)]
    assert not wrong
    assert lattice.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_licences(edge, nothing, spark):
    notices = {"mit": "Released under the MIT License.", "gpl-3.0": "x\nThis work is licensed under the GNU General Public License, version 3.\ny",
               "apache-2.0": "intro words here. Licensed under the Apache License, Version 2.0.", "cc-by-nc": "Licensed under CC BY-NC 4.0."}
    clean = ["The license plate was missing.", "All rights reserved.", prose(1, 50), "", None, "version 3 of the general plan", "Licensed under the Foo Public License, version 7."]
    docs = spark.createDataFrame([*notices.items(), *((f"none{k}", t) for k, t in enumerate(clean))], "doc_id string, text string")
    for r in licenses.scan_licences(docs, ["doc_id"]).collect():
        assert r.licences == ([r.doc_id] if r.doc_id in notices else []), r
    assert licenses.scan_licences(edge, edge.columns).filter("size(licences) > 0").count() == 0
    assert licenses.scan_licences(nothing, ["doc_id"]).count() == 0


@pytest.mark.parametrize("width", [34, 50, 66, 90])
def test_wrapped_licences(spark, width):
    """Every notice wrapped over comment lines between prose is found with its family and no other, on its lines."""
    rows, want = [], {}
    for family, texts in licenses.TEMPLATES.items():
        for k, text in enumerate(texts):
            wrapped = ["# " + line for line in textwrap.wrap(text, width)]
            rows.append((f"{family} {k}", "\n".join([prose(1, 12), *wrapped, prose(2, 12)])))
            want[f"{family} {k}"] = [family]
    got = licenses.scan_licences(spark.createDataFrame(rows, "doc_id string, text string"), ["doc_id"]).collect()
    assert {r.doc_id: r.licences for r in got} == want
    assert all(len([n for n in r.notices if n.confirmed]) == 1 and r.n_paragraphs <= 6 for r in got)


def test_notices_in_a_row_stay_apart(spark):
    lines = ["Released under the MIT License.", "Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: Apache-2.0", "Licensed under CC BY-NC 4.0.", "",
             "This program is free software; you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by",
             "the Free Software Foundation; either version 2 of the License, or", "(at your option) any later version."]
    row = licenses.scan_licences(spark.createDataFrame([("\n".join(lines),)], "text string"), []).first()
    assert [(n.line, n.last_line, n.family) for n in row.notices] == [(0, 0, "mit"), (1, 1, "cc-by-sa"), (2, 2, "apache-2.0"), (3, 3, "cc-by-nc"), (5, 8, "gpl-2.0")]
    assert row.n_paragraphs == 5


def test_licence_variants():
    """Held-out variants of every template: lost words, words around it."""
    model = licenses.fit_licences()
    rng, right, all_ = np.random.default_rng(99), 0, 0
    for family, texts in licenses.TEMPLATES.items():
        for text in texts:
            words = licenses.WORD.findall(text.lower())
            for _ in range(5):
                kept = [w for w in words if len(words) < 8 or rng.random() > 0.05]
                all_ += 1
                right += model.classify(["zuk", "mor", *kept, "tel"])[0] == family
    assert right >= 0.9 * all_


def test_toxicity_learns(spark, edge, nothing):
    bad, rows, labels = ["slur", "vile", "nasty"], [], []
    for k in range(1200):
        words = prose(k, 60).split()
        toxic = k % 8 == 0
        if toxic:
            words[k % 50:k % 50] = [bad[k % 3], bad[(k // 8) % 3], bad[(k // 24) % 3]]
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, known)
    got = toxicity.score_toxicity(docs, model).collect()
    held = [r for r in got if r.held_out]
    assert 150 < len(held) < 350
    assert sum(r.predicted == dict(labels)[r.doc_id] for r in held) >= 0.97 * len(held)
    again = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, known)).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in got)
    scores = toxicity.score_toxicity(edge, model).collect()
    assert len(scores) == 15 and all(0 <= r.score <= 1 for r in scores)
    none = toxicity.fit_toxicity(docs, known.filter("toxic = 5"))
    assert toxicity.score_toxicity(nothing, none).count() == 0


def test_toxic_features_equal_plain_counts(spark):
    """Counts, slots and choice in Spark against plain Python; more candidates than any list would hold are not cut."""
    bad = [(f"bad{k % 20} " * 3 + prose(k, 30)) for k in range(600)]
    texts = bad + [prose(k, 40) for k in range(600, 3000)]
    frame = lambda rows: spark.createDataFrame([(t,) for t in rows], "text string")
    positive = toxicity.count_features(frame(bad))
    slots = toxicity.feature_slots(positive)
    everything = toxicity.count_features(frame(texts), slots)
    plain = lambda rows: Counter(f for t in rows for f in [*toxicity.features(t), ""])
    a, b = plain(bad), plain(texts)
    counted = dict(everything.collect())
    assert dict(positive.collect()) == a and all(counted[f] == b[f] for f in a)
    scored = []
    for word, n in a.items():
        expected = a[""] * min(b[word] / b[""], 1 - 1e-9)
        deviance = 2 * (n * math.log(n / expected) - (n - expected))
        if word and n >= toxicity.LEAST_DOCS and n >= toxicity.LEAST_LIFT * expected and deviance >= toxicity.LEAST_DEVIANCE:
            scored.append((-round(deviance, 9), word))
    want = [w for _, w in sorted(scored)]
    got = toxicity.select_features(positive, everything)
    assert len(want) >= 20 and set(got) == set(want)
    assert toxicity.select_features(positive, everything, 7) == got[:7]


def test_toxicity_edges(spark, edge, nothing):
    """Empty tables, repeated labels and clashing columns give a model and a score for every row."""
    labels = spark.createDataFrame([(4, 1, "a"), (4, 1, "b"), (5, 0, "c"), (None, 1, "d"), (6, None, "e")], "doc_id long, toxic int, text string")
    for docs, known in ((edge, labels), (edge, labels.limit(0)), (nothing, labels)):
        model = toxicity.fit_toxicity(docs, known, most_positive=2, most_unlabelled=5)
        assert toxicity.score_toxicity(edge, model).count() == 15 and toxicity.score_toxicity(nothing, model).count() == 0


def test_held_out_labels_do_not_matter(spark):
    docs = spark.createDataFrame([(k, prose(k, 30)) for k in range(100)], "doc_id long, text string")
    from pyspark.sql import functions as F

    labels = docs.select("doc_id", F.when(toxicity.held_out(F.col("doc_id")), 1).otherwise(0).alias("toxic"))
    assert toxicity.fit_toxicity(docs, labels).weights == {}


URLS = [None, "", "no scheme", "http://NET/", "https://a.b.NET/x?q#f", "http://net", "http://example.net/en/1", "http://www.example.net/en", "http://xexample.net/en/", "s://example.com/de/x",
        "s://a.example.com/fr/", "s://w.org/fr/", "s://w.org/de/", "://host/p://q", "http://cheap-pills.example.com/fr/", "http://ÄNET.net/ü/?", "http://net/?a", "http://.net/", "http://example.com/de/\n2"]


def test_urls_both_ways(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("b.net", "/x", "allow")]
    pages = spark.createDataFrame([(k, u, "mine") for k, u in enumerate(URLS)], "page_id long, url string, verdict string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")

    def judge(url):
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.split(r"[/?#]", rest)[0]
            path = re.split(r"[?#]", rest[len(host):])[0]
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[1:] if fits else (None, "allow")))

    want = {k: judge(u) for k, u in enumerate(URLS)}
    for most in (1000, 2):
        got = urls.judge_urls(pages, table, most_rules=most)
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()} == want
    assert urls.judge_urls(pages.limit(0), table).count() == 0


def test_digest_collisions(tmp_path, monkeypatch):
    monkeypatch.setattr(urls, "digest", lambda host, path: 7)
    file = tmp_path / "rules"
    file.write_bytes(urls.DigestArray.pack([("a", "/", "block"), ("b", "/", "allow"), ("a", "/", "allow")]))
    table = urls.DigestArray(str(file))
    assert table.match(["a", "x.b", "c"], ["/", "/q", "/"]) == (["a/", "b/", None], ["allow", "allow", None])


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        from tidewatch.session import settle

        docs = settle(stage(spark, docs, SF))
        assert docs.columns == columns
        n.append(docs.count())
    assert n[1] < n[0] and n[2] == n[1] and n[3] < n[2] and n[4] > 0
    final = pipeline.run(spark, SF)
    assert final.count() == n[4]


@pytest.mark.parametrize("name", ["op3_simhash_classes", "op5_license_scan", "op8_toxicity_nnpu"])
def test_query_covers_all_documents(spark, name):
    assert QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
