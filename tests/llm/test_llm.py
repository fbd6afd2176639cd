"""Operators against SQL, brute force and held-out accuracy, and their defined results on odd input."""

import hashlib
import random
import re
import textwrap
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import caps, chat, decontam, html_crf, licenses, mixing, quality, queries, simhash, suffix, toxicity
from test_contract import SF, same

ODD = [(None, None, None), (1, "", "s"), (2, "   ", "s"), (3, "word " * 30_000, None), (4, "a b c d", "s"), (4, "a b c d", "s"), (5, None, "t")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank and very long texts, repeated rows, and clashing extra columns."""
    rows = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    return rows.withColumns({"fp": F.lit(1), "rid": F.lit(2), "key": F.lit("k"), "n_words": F.lit(3), "score": F.lit(0.5), "kept": F.lit(True), "size": F.lit(9)})


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    same(spark, name, queries.ORACLE[name], queries.QUERIES[name])


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fuzzy_keys_meet_within_three_errors():
    r = np.random.default_rng(0)
    base = r.integers(0, 2**63, 300, dtype=np.uint64)
    for lo, hi in ((0, 64), (0, 23), (23, 46), (46, 64)):
        for k in range(4):
            other = base.copy()
            for j in range(len(base)):
                for b in r.choice(np.arange(lo, hi), k, replace=False):
                    other[j] ^= np.uint64(1) << np.uint64(b)
            row, key = simhash.fuzzy_keys(np.concatenate([base, other]))
            keys = [set() for _ in range(600)]
            for i, x in zip(row.tolist(), key.tolist(), strict=True):
                keys[i].add(x)
            assert all(keys[i] & keys[i + 300] for i in range(300))


def test_simhash_brute(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd.where("doc_id > 0 and doc_id <> 4").select(F.col("doc_id") + 10_000, "text"))
    rows = docs.collect()
    fp = [brute_fingerprint(r.text) for r in rows]
    root = {r.doc_id: r.doc_id for r in rows}
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(rows):
            for j, b in enumerate(rows[:i]):
                if root[a.doc_id] != root[b.doc_id] and (fp[i] ^ fp[j]).bit_count() <= 3:
                    root[a.doc_id] = root[b.doc_id] = min(root[a.doc_id], root[b.doc_id])
                    changed = True
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert {k: r.component_id for k, r in got.items()} == root
    assert all(r.fingerprint == f"{f:016x}" for r, f in ((got[x.doc_id], f) for x, f in zip(rows, fp, strict=True)))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_simhash_deals_hot_keys(spark):
    r = np.random.default_rng(1)
    fps = np.unique(np.concatenate([np.uint64(77) ^ (np.uint64(1) << r.integers(0, 64, 60).astype(np.uint64)), r.integers(0, 2**60, 60, dtype=np.uint64)]))
    number = {int(f.view(np.int64)): i for i, f in enumerate(fps)}
    keys = spark.createDataFrame([(5, f) for f in number], "key long, fp long")
    pairs = {tuple(sorted((number[x.a], number[x.b]))) for x in simhash.link_keys(keys, most=10).collect()}
    linked = lambda i, j: int(fps[i] ^ fps[j]).bit_count() <= 3
    assert all(linked(*p) for p in pairs)

    def parts(edges):
        root = list(range(len(fps)))
        for _ in fps:
            for i, j in edges:
                root[i] = root[j] = min(root[i], root[j])
        return root

    assert parts(pairs) == parts([(i, j) for i in range(len(fps)) for j in range(i) if linked(i, j)])


def test_caps_brute(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(60, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(100 + i, (v + 0.04 * r.normal(size=16)).tolist()) for i, v in enumerate(base)] + [(200, base[0].tolist()), (200, base[0].tolist()), (300, None), (301, [0.0] * 16), (302, [1.0, None]), (303, [float("nan")] * 16), (304, []), (305, [1.0, 0.0])]
    got = {(x.vec_id, x.n_links, x.component_id) for x in caps.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), most=4).collect()}
    good = [(i, np.array(v)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    cos = lambda a, b: len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95
    n = {i: sum(cos(v, w) for _, w in good) - 1 for i, v in good} | {i: 0 for i in (300, 301, 302, 303, 304)}
    assert {(i, k) for i, k, _ in got} == set(n.items())
    assert {c for i, _, c in got if i == 200} == {0}


def test_mixing(spark, odd):
    assert mixing.targets([10, 10, 100], [5, 2, 1]) == pytest.approx([30, 30, 60])
    _, parts = mixing.mix(odd)
    rows = parts.collect()
    assert len(rows) == len(ODD) and all(r.taken <= 3 * r["size"] for r in rows)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    blocks, parts = mixing.mix(docs)
    again = mixing.mix(docs.repartition(5))[1]
    key = lambda p: sorted((r.doc_id, r["size"], r.taken) for r in p.collect())
    assert key(parts) == key(again)
    for r in parts.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect():
        assert abs(r.t - r.g) <= max(mixing.BLOCK, 0.03 * r.g)
    assert sum(r.n_words for r in blocks.collect()) == sum(r.taken for r in parts.collect())
    assert sorted(mixing.permute(np.arange(1000), 1000, "k").tolist()) == list(range(1000))
    assert mixing.mix(docs.limit(0))[1].count() == 0


def test_toxicity_restores_and_scores(spark, odd):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    for written, meant in (("you m0r0n", "moron"), ("a tr@sh", "trash"), ("so stuuuupid", "stupid"), ("s c u m", "scum"), ("l.o.s.e.r", "loser")):
        assert meant in toxicity.Restorer(model.lm)(f"The {written} there").split(), written
    joined = toxicity.score(docs, model).join(labels, "doc_id").where("toxic is not null")
    held = joined.where(toxicity.crc_fold(F.col("doc_id")) == 0).agg(F.avg(((F.col("score") >= 0.5) == (F.col("toxic") == 1)).cast("int"))).first()[0]
    assert held > 0.93
    assert toxicity.score(odd, model, out="s").count() == len(ODD)
    assert toxicity.score(odd, toxicity.train(odd, labels.limit(0)), out="s").first().s == 0.5


def plain_model(said):
    """A model of ``said`` as the corpus, in which some words are known as toxic."""
    weights = {w: 6.0 for w in ("moron", "idiot", "scum", "stupid", "worthless", "ass")}
    return toxicity.Model(toxicity.LanguageModel(toxicity.trigram_counts(iter(said))), weights, np.array([1.0, 0.0, 0.0, 0.0, -3.0]))


SAID = ["you are a moron and an idiot. the scum and stupid are worthless, as all of them know. we found the letter in the harbour."] * 20


def test_toxicity_stretches_of_every_length():
    model = plain_model(SAID)
    score = model.scorer()
    said = "you are a worthless moron and all of them know it idiot"
    for text in (" ".join(said.replace(" ", "")), "  ".join(" ".join(w) for w in said.split()), "stu" + "p" * 70 + "id", " ".join("the harbour and the letter".replace(" ", "") * 100) + " m o r o n"):
        assert len(text) > 64 and score(text) > 0.9, text
    assert score(" ".join("the harbour and the letter".replace(" ", ""))) < 0.1
    restored = toxicity.Restorer(model.lm)("y o u a r e a m o r o n " * 5000)
    assert restored.split().count("moron") > 4000


def test_toxicity_gate():
    model = plain_model(SAID)
    score, restore = model.scorer(), toxicity.Restorer(model.lm)
    hidden = ["a s s", "s/c/u/m", "s~c~u~m", "s\nc\nu\nm", "s   c   u   m", "s|c|u|m", "idio7", "as$", "you-m0r0n", "all,m0r0n", "(m0r0n)", "m0-ron", "idiot7", "idiot$$$", "idiot!!"]
    for text in hidden:
        assert score(f"the {text} there") > 0.9, (text, restore(text))
    for text in ("2024", "1.5 2.0", "a | b | c", "the letter!", "the harbour-letter", "", None):
        assert score(text) < 0.1, (text, restore(text))
    assert restore("in 2024, 17.5 of 300") == "in 2024, 17.5 of 300"
    for text in ("!" * 50_000, "a" * 50_000, "a-" * 50_000, "! " * 50_000, "1" * 50_000 + "a"):
        restore(text)


def test_quality(spark, odd):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    joined = quality.classify(docs, labels).join(labels, "doc_id")
    held = joined.where(quality.crc_fold(F.col("doc_id")) == 0).agg(F.avg(((F.col("score") >= 0.3) == (F.col("quality") == 1)).cast("int"))).first()[0]
    assert held > 0.93
    assert quality.classify(odd, labels).count() == len(ODD)
    assert quality.classify(odd.limit(0), labels).count() == 0
    assert {r.score for r in quality.classify(odd, labels.limit(0)).collect()} == {0.5}


def test_html(spark):
    chain = html_crf.default_chain()
    pages = [html_crf.Drawn(k).page() for k in range(90_000_000, 90_000_120)]
    right = total = 0
    for page, labels in pages:
        found = html_crf.blocks(page)
        if len(found) == len(labels):
            got = chain.decode(html_crf.features(found))
            right, total = right + sum(a == b for a, b in zip(got, labels, strict=True)), total + len(labels)
    assert right / total > 0.97
    page = "<html><head><title>t</title></head><body><nav><ul><li><a href=x>Home</a></ul></nav><article><h1>A &amp; B</h1><p>One\n  two <b>three.<p>Four &lt;five&gt; six seven eight.</article><footer>&copy; us</footer>"
    assert html_crf.main_text(page, chain) == "A & B\nOne two three.\nFour <five> six seven eight."
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "<p"), (4, "<!-- x"), (5, page), (5, page)], "page_id long, html string").withColumn("text", F.lit("x"))
    got = html_crf.extract(rows).collect()
    assert [len(r.text) == r.n_chars for r in got] == [True] * 6 and got[0].text == "" and got[4].text == got[5].text
    assert html_crf.extract(rows.limit(0)).count() == 0


def test_licenses(spark):
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/b/c/x.py", "code only"), ("a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("a/z.py", "import sys and print every argument of it\nLicensed under the Apache License, Version 2.0.\nreturn value of main function to shell"), ("q/n.py", None), (None, "Released under the MIT License."), ("top.py", "")]
    files = spark.createDataFrame(rows, "path string, text string").withColumn("license", F.lit("x"))
    got = {r.path: (r.stated, r.inherited, r.license) for r in licenses.scan(files).collect()}
    assert got["a/b/c/x.py"] == (None, "GPL-3.0", "GPL-3.0") and got["a/z.py"] == ("Apache-2.0", "MIT", "Apache-2.0")
    assert got["q/n.py"] == (None, None, None) and got[None] == ("MIT", None, "MIT") and got["top.py"] == (None, None, None)
    assert licenses.scan(files.limit(0)).count() == 0
    # key terms lose nothing: every line is scored, with and without them
    t = licenses.Templates({}, 10)
    lines = [x for v in licenses.TEMPLATES.values() for x in v] + ["the work of a file and the use of it", "terms and conditions may apply to any copy"]
    full = licenses.Templates({}, 10)
    full.key = set(full.index)
    for x in lines:
        c = licenses.Counter(licenses.terms(x))
        a, b = t.best(c), full.best(c)
        assert a == b or b[1] < licenses.WHOLE


def test_licenses_whole_texts_headers_and_paragraphs(spark):
    texts = licenses.license_texts()
    gnu = lambda what, name, version: licenses._gnu(what, name, version, licenses._SEE)
    wrap = lambda t: "\n".join("# " + x for x in textwrap.wrap(t, 70))
    rows = [(name, t) for name, t in texts.items()] + [(name, " ".join(t.split())) for name, t in texts.items()]
    for name, t in (("GPL-2.0", gnu("program", licenses._GPL, "2")), ("GPL-3.0", gnu("program", licenses._GPL, "3")), ("LGPL-2.1", gnu("library", licenses._LGPL, "2.1")), ("LGPL-3.0", gnu("library", licenses._LGPL, "3")), ("AGPL-3.0", gnu("program", licenses._AGPL, "3")), ("Apache-2.0", licenses.TEMPLATES["Apache-2.0"][2])):
        rows += [(name, t), (name, wrap(t)), (name, wrap(t) + "\nimport sys\n" + "print the sum of numbers\n" * 50)]
    rows += [("MIT", "This is a tool for sums. Released under the MIT License. Readers find more below, with many words about other things of interest."), ("MIT", "A readme about sums\n\n" + texts["MIT"] + "\nAnd more of the numbers\n" * 30), ("BSD-2-Clause", "Released under the BSD 2-Clause License."), ("EPL-2.0", "Licensed under the Eclipse Public License, version 2.0."), ("BSD-3-Clause", "Copyright (c) 2020 Ann. All rights reserved.\n" + texts["BSD-3-Clause"]), ("BSD-2-Clause", texts["BSD-2-Clause"].replace("\nmodification, are", " modification, are").replace("conditions\nare met", "conditions are met")), (None, "code and words of it\nfor the sum of the numbers")]
    files = spark.createDataFrame([(f"d{i}/x", name, t) for i, (name, t) in enumerate(rows)], "path string, name string, text string")
    wrong = [(r.name, r.stated, r.stated_score, rows[int(r.path[1:-2])][1][:80]) for r in licenses.scan(files, keep=["path", "name"]).collect() if r.stated != r.name]
    assert not wrong, wrong


def test_decontamination(spark, odd):
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20))), (2, "Short One"), (None, "odd item"), (3, ""), (4, None), (2, "Short One")], "item_id long, text string")
    text = "Start, " + " ".join(f"W{i}" for i in range(3, 18)) + " and short-one; odd item end"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string").withColumn("spans", F.lit(1))
    for most in (1 << 20, 20):
        r = decontam.contamination(docs, bench, most_nodes=most).orderBy("doc_id").collect()
        assert (r[0].n_words, r[0].n_hit, r[0]["items"]) == (22, 15 + 2 + 2, [1, 2])
        assert [text[x["from"] : x["to"]] for x in r[0].offsets][1] == "short-one; odd item"
        assert (r[1].n_words, r[1].n_hit, r[2].n_hit) == (0, 0, 0)
    assert decontam.contamination(odd, bench.limit(0)).where("n_hit > 0").count() == 0


def test_chat(spark):
    said = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 400, "ann", "bye"), (1, None, None, "?"), (1, 1, "ann", "hi"), (None, 0, "ann", "x"), (2, 0, "system", "alone")], "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(1))
    rows = chat.rotate(said).collect()
    for who in ("ann", "bob"):
        mine = sorted((r for r in rows if r.conv_id == 1 and r.perspective == who), key=lambda r: r.seq)
        whole = "".join(r.segment for r in mine)
        assert [r.seq for r in mine] == list(range(1, 7))
        assert [whole[r.from_char : r.to_char] for r in mine] == ["s", "hi", "hi", "", "bye", "?"]
        assert [r["mask"] for r in mine] == [x == who for x in ("", "ann", "ann", "bob", "ann", "")]
    assert {r.conv_id for r in rows} == {1, None}
    assert chat.rotate(said.limit(0)).count() == 0


def brute_repeats(rows, n=50):
    first = {}
    for d, t in rows:
        b, k = (t or "").encode(), suffix.LAST + 1 if d is None else d
        for i in range(len(b) - n + 1):
            first[b[i : i + n]] = min(k, first.get(b[i : i + n], suffix.LAST + 1))
    out = []
    for d, t in rows:
        b, k = (t or "").encode(), suffix.LAST + 1 if d is None else d
        keep = bytearray(b"\1" * len(b))
        for i in range(len(b) - n + 1):
            if first[b[i : i + n]] < k:
                keep[i : i + n] = bytes(n)
        out.append((d, hashlib.sha256(bytes(x for x, y in zip(b, keep, strict=True) if y)).hexdigest()))
    return sorted(map(str, out))


def repeat_rows():
    r = random.Random(3)
    base = "".join(r.choice("abcdefg ") for _ in range(400))
    rows = [(None, None), (5, ""), (7, "x" * 300), (6, "x" * 200), (6, "x" * 200), (None, base), (3, base[100:300]), (9, base * 2), (9, "é" * 120), (2, "é" * 60), (11, "ab" * 100), (10, "ba" * 90)]
    return rows + [(20 + i, base[r.randrange(200) :][:150] + r.choice(["q", "zz"]) + base[50:130]) for i in range(30)] + [(80, "".join(r.choice("abcdefg ") for _ in range(200_000)) + base)]


def digests(found):
    return sorted(str((x.doc_id, hashlib.sha256(bytes(x.kept)).hexdigest())) for x in found.collect())


@pytest.mark.parametrize(("part", "hot", "collide"), [(500, 2048, False), (1 << 19, 1, False), (1 << 19, 2048, True)])
def test_repeats_brute(spark, monkeypatch, part, hot, collide):
    digest = (lambda raw: bytes(15) + bytes([len(raw) & 1])) if collide else xxhash.xxh3_128_digest
    monkeypatch.setattr(suffix, "SORT_BYTES", part)
    monkeypatch.setattr(suffix, "BUCKETS", 1 << 12)
    rows = repeat_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).repartition(3)
    assert digests(suffix.dedup_substrings(docs, hot_rows=hot, digest=digest)) == brute_repeats(rows)


def test_repeats_other_lengths_and_ids(spark):
    rows = [((1 << 63) - 1 if d == 3 else d, t) for d, t in repeat_rows()[:-1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert digests(suffix.dedup_substrings(docs, length=100)) == brute_repeats(rows, 100)
    assert digests(suffix.dedup_substrings(docs, length=30, gram=30)) == brute_repeats(rows, 30)
    assert suffix.dedup_substrings(docs.limit(0)).count() == 0
    text = {r.doc_id: r.kept for r in suffix.dedup_substrings(docs, as_text=True).collect()}
    assert text[2] == "é" * 60 and text[5] == ""


def test_repeats_in_small_blocks(spark, monkeypatch):
    for name, n in (("ANCHORS", 300), ("BLOCK_BYTES", 5000), ("PART_WINDOWS", 4000), ("SORT_BYTES", 3000)):
        monkeypatch.setattr(suffix, name, n)
    monkeypatch.setattr(suffix, "BUCKETS", 1 << 12)
    rows = repeat_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert digests(suffix.dedup_substrings(docs, hot_rows=20)) == brute_repeats(rows)


def test_hot_windows_that_are_settled_go_on_as_spans():
    r = random.Random(5)
    some = lambda n: bytes(r.randrange(97, 123) for _ in range(n))
    passage, bits = some(150), suffix._bits(50, 20)
    texts = [some(59) + bytes([d]) + passage + bytes([d]) + some(59) for d in range(200)]
    wanted = []
    for text in texts:
        h, first, stop = suffix.anchors(np.frombuffer(text, np.uint8), [])
        wanted.append([{"run": int(a) << bits | int(b - a), "h": int(x)} for x, a, b in zip(h.view(np.int64), first, stop, strict=True)])
    batch = pa.RecordBatch.from_pydict({"doc": range(200), "rid": range(200), "text": pa.array(texts, pa.binary()), "wanted": pa.array(wanted, pa.list_(pa.struct([("run", pa.int64()), ("h", pa.int64())])))})
    hot = SimpleNamespace(value=np.arange(suffix.BUCKETS))
    rows = [x for out in suffix._contexts(50, 20, hot)(iter([batch])) for x in out.to_pylist()]
    # windows in the passage: of the first document a row each, of every other one row in all
    known = [x for x in rows if x["bytes"] is None]
    assert [(x["doc"], x["from"], x["to"]) for x in sorted(known, key=lambda x: x["doc"])] == [(d, 60, 161) for d in range(1, 200)]
    assert len(rows) == len(known) + 101 + 200 * (60 + 60)
    assert all(x["bytes"] == texts[x["rid"]][x["from"] : x["from"] + 50] for x in rows if x["bytes"])


def test_leads_by_bytes():
    data = np.frombuffer(b"abcabdabcabc", np.uint8)
    at, size = np.array([0, 3, 6, 9, 6]), np.array([3, 3, 3, 3, 6])
    assert suffix.leads(data, at, size, np.zeros(5, np.uint64), np.array([4, 5, 2, 4, 1])).tolist() == [2, 1, 2, 2, 4]


def test_suffix_sort():
    data = np.frombuffer(b"banana bandana banana" + bytes(50), np.uint8)
    ext = suffix.Extensions(data, 50)
    order = suffix.suffix_sort(ext, np.arange(21), np.zeros(21, int))
    raw = data.tobytes()
    assert [raw[i : i + 50] for i in order] == sorted(raw[i : i + 50] for i in range(21))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF).cache()
        assert after.columns == names and after.count() <= docs.count()
        assert after.select("doc_id").subtract(docs.select("doc_id")).count() == 0
        docs = after
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_pipeline_against_plain_python(spark, tmp_path):
    """Each stage's rows, and run()'s, on documents of known kinds."""
    r = random.Random(7)
    vocabulary = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(3)) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    clean = [(i, prose(60)) for i in range(60)]
    toxic = [(100 + i, prose(30) + " moron " + prose(30)) for i in range(40)]
    asked = prose(20)
    shared = prose(12)
    more = [(200, clean[0][1]), (201, clean[1][1]), (300, prose(20) + " " + asked + " " + prose(20)), (301, shared + " " + prose(60)), (302, prose(40) + " " + shared), (303, None), (304, "")]
    rows = [(d, t, "en", "ab"[d % 2], len(t or "")) for d, t in clean + toxic + more]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    tables = {"documents": spark.createDataFrame(rows, schema), "labels": spark.createDataFrame([(d, 1, int(100 <= d < 140)) for d, _ in clean + toxic], "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame([(1, asked)], "item_id long, text string")}
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = {d: x for d, *x in rows if not 100 <= d < 140}
    after = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        if k == 1:  # one of each group of equal fingerprints or ones at most three bits apart
            fp = {d: brute_fingerprint(x[0]) for d, x in want.items()}
            root = {d: d for d in want}
            for _ in want:
                for a in want:
                    for b in want:
                        if root[a] != root[b] and (fp[a] ^ fp[b]).bit_count() <= 3:
                            root[a] = root[b] = min(root[a], root[b])
            want = {d: x for d, x in want.items() if root[d] == d}
            assert {200, 201}.isdisjoint(want)
        if k == 2:
            seen: set[bytes] = set()
            for d in sorted(want):
                b = (want[d][0] or "").encode()
                grams = [b[i : i + 50] for i in range(len(b) - 49)]
                cut = {j for i, g in enumerate(grams) if g in seen for j in range(i, i + 50)}
                seen.update(grams)
                left = bytes(x for j, x in enumerate(b) if j not in cut).decode()
                want[d] = [left, *want[d][1:3], len(left)]
            assert len(want[302][0]) < len(more[4][1])
        if k == 3:
            bad = {" ".join(asked.split()[i : i + 13]) for i in range(8)}
            def hit(t):
                w = (t or "").split()
                return len({j for i in range(len(w)) if " ".join(w[i : i + 13]) in bad for j in range(i, i + 13)}), len(w)
            want = {d: x for d, x in want.items() if not (hit(x[0])[0] and 20 * hit(x[0])[0] >= hit(x[0])[1])}
            assert 300 not in want
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == [f.split()[0] for f in schema.split(", ")]
        got = {x.doc_id: list(x)[1:] for x in docs.collect()}
        assert len(got) == docs.count() and got == want, (k, got.keys() ^ want.keys())
    last = [tuple(x) for x in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()]
    size = {d: len((x[0] or "").split()) for d, x in want.items()}
    assert {x[0]: x[1:3] for x in last} == {d: (x[2], size[d]) for d, x in want.items()}
    assert {x[3] for x in last if x[1] == "a"} == {sum(size[d] for d, x in want.items() if x[2] == "a")}
    key = lambda rows: sorted(map(str, rows))
    assert key(tuple(x) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()) == key(last)
