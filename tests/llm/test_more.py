"""Operators against brute force: all paths, all labelings, recounted blocks, risks by hand; odd input of every stage."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import caps, chat, common, decontam, html_crf, licenses, mixing, quality, simhash, suffix, toxicity
from test_contract import SF

TOP = (1 << 63) - 1
CLASHING = ["_score", "score", "kept", "spans", "n_hit", "n_words", "fp", "rid", "key", "doc", "c0", "part", "target", "taken", "size", "component_id", "fingerprint"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_simhash_any_id(spark):
    near = "one two three four five six seven eight nine ten"
    rows = [((1 << 62) + 5, near), ((1 << 62) + 9, near), (TOP, "other words"), (None, "other words"), (None, "alone here"), (-7, None), (3, ""), (-7, "x y"), (-7, "x y")]
    got = [(r.doc_id, r.component_id, r.kept) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    want = [((1 << 62) + 5, (1 << 62) + 5, True), ((1 << 62) + 9, (1 << 62) + 5, False), (TOP, TOP, True), (None, TOP, False), (None, None, True), (-7, -7, True), (3, -7, False), (-7, -7, True), (-7, -7, False)]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string, fp int")).count() == 0


def test_caps_any_value_and_id(spark):
    rows = [(TOP, [1e301, 0.0]), (-5, [1e301, 1.0]), (None, [2e-320, 0.0]), (None, [0.0, 3.0]), (8, [0.0, 3.0]), (9, [float("inf"), 1.0]), (None, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"node": F.lit(1), "copies": F.lit("c"), "v": F.lit(0)})
    got = sorted(((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in caps.near_duplicates(frame).collect()), key=str)
    assert got == sorted([(False, TOP, 2, -5, False), (False, -5, 2, -5, True), (True, 0, 2, -5, False), (True, 0, 1, 8, False), (False, 8, 1, 8, True), (False, 9, 0, 9, True), (True, 0, 0, None, False)], key=str)
    assert caps.near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("dim", [32, 64, 384])
def test_caps_recall_at_the_threshold(dim):
    r = np.random.default_rng(dim)
    a = r.normal(size=(400, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = r.normal(size=(400, dim))
    b -= (a * b).sum(axis=1)[:, None] * a
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1)[:, None]
    met = [bool(np.intersect1d(x, y).size) for x, y in zip(caps.filters(a), caps.filters(b), strict=True)]
    assert np.mean(met) >= 0.97


def test_mixing_blocks_recounted(spark):
    r = random.Random(4)
    rows = [(None if i % 17 == 0 else i, None if i % 13 == 0 else " ".join(f"w{i}.{k}" for k in range(r.randrange(0, 90))), r.choice([None, "a", "b", "c", "\U0001f600", "￿"])) for i in range(120)] + [(5, "same row here", "a")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"rid": F.lit(1), "part": F.lit(2), "tie": F.lit("t")})
    blocks, parts = mixing.mix(docs, block=16, shard_blocks=5)
    blocks, parts = blocks.collect(), parts.collect()
    names = sorted({r.source for r in parts}, key=lambda x: (x is None, x or ""))
    size = {s: sum(r["size"] for r in parts if r.source == s) for s in names}
    assert {s: {r.source_size for r in parts if r.source == s} for s in names} == {s: {n} for s, n in size.items()}
    assert {r.source: r.target for r in parts} == pytest.approx(dict(zip(names, mixing.targets([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True)))
    place = {}
    for s in names:  # documents end to end
        at = 0
        for p in sorted((p for p in parts if p.source == s), key=lambda p: p.doc_no):
            place[s, p.doc_no], at = at, at + p["size"]
        assert sorted(p.doc_no for p in parts if p.source == s) == list(range(sum(p.source == s for p in parts)))
    slots = {}
    for b in blocks:
        slots.setdefault((b.source, b.slot), []).append(b)
    for (s, slot), found in slots.items():  # a slot holds one whole block
        assert len({(b.shard, b.block_no, b["pass"]) for b in found}) == 1
        spans = sorted((place[s, b.doc_no] + b.from_word, b.n_words) for b in found)
        first = 16 * found[0].block_no
        assert spans[0][0] == first and sum(n for _, n in spans) == min(16, size[s] - first)
        assert found[0]["pass"] == slot // -(-size[s] // 16)
    for s in names:  # slots are numbered without gaps, and a pass draws a block once
        mine = sorted(k for n, k in slots if n == s)
        assert mine == list(range(len(mine)))
        drawn = [(slots[s, k][0]["pass"], slots[s, k][0].block_no) for k in mine]
        assert len(set(drawn)) == len(drawn)
    per = {}
    for s, k in slots:
        per[slots[s, k][0].shard] = per.get(slots[s, k][0].shard, 0) + 1
    assert all(n == 5 for shard, n in per.items() if shard != max(per))
    taken = {}
    for b in blocks:
        taken[b.source, b.doc_no] = taken.get((b.source, b.doc_no), 0) + b.n_words
    assert {(p.source, p.doc_no): p.taken for p in parts if p.taken} == taken
    assert sum(p["size"] for p in parts) == sum(len(x.split()) for _, x, _ in rows if x)
    with pytest.raises(ValueError):
        mixing.mix(docs, most_sources=2)


def test_settled_slots():
    r = np.random.default_rng(0)
    for _ in range(30):
        n = int(r.integers(1, 6))
        quota = r.integers(0, 30, n)
        quota[0] += 1
        drawn = r.multinomial(quota.sum(), quota / quota.sum())
        settled = mixing.Settled(quota, drawn)
        out = [x for i in range(n) for x in zip(*(v.tolist() for v in settled(i, np.arange(drawn[i]))), strict=True)]
        assert sorted(out) == [(i, k) for i in range(n) for k in range(quota[i])]


def readings(written, model):
    """Every reading of a stretch, with its least cost."""
    runs = [(m[0][0], len(m[0])) for m in re.finditer(r"(.)\1*", written, re.S)]
    choices = []
    for i, (ch, n) in enumerate(runs):
        here = [(x * k, c + toxicity.REPEAT_COST * (n - k)) for x, c in ([(ch, 0.0)] if ch.isalpha() else [(x, toxicity.SUBSTITUTE_COST) for x in toxicity.SUBSTITUTES.get(ch, "")]) for k in range(1, min(n, 3) + 1)]
        if not ch.isalpha():
            here.append((ch * n, toxicity.KEEP_COST))
            sub = ch in toxicity.SUBSTITUTES
            if i in (0, len(runs) - 1):
                here.append((" ", toxicity.EDGE_COST if sub and ch != "!" else toxicity.SEPARATOR_COST))
            elif not sub and not ch.isalnum():
                here += [("", toxicity.SEPARATOR_COST), (" ", toxicity.SEPARATOR_COST)]
        choices.append(here)
    out = {}
    for path in itertools.product(*choices):
        said = "".join(x for x, _ in path)
        symbols = [0, 0, *(ord(x) - 96 if "a" <= x <= "z" else 27 if x.isalpha() else 0 for x in said), 0]
        cost = sum(c for _, c in path) + sum(model.cost[a, b, c] for a, b, c in zip(symbols, symbols[1:], symbols[2:], strict=False))
        out[said] = min(cost, out.get(said, math.inf))
    return out


def test_toxicity_all_lattice_paths():
    said = ["you are a moron and an idiot, the scum and stupid are worthless as all of them know, so he said."] * 5
    model = toxicity.LanguageModel(toxicity.trigram_counts(iter(said)))
    for written in ("m0r0n", "5tup1d", "stuuupid", "!d10t", "a$$", "sc|um!", "7h3", "l1ar", "(m0r0n)", "10", "0", "é7a"):
        costs = readings(written, model)
        got = toxicity.decode(written, model)
        assert costs[got] == pytest.approx(min(costs.values())), (written, got, min(costs, key=costs.get))


def test_toxicity_odd_tables(spark):
    rows = [(1, "you moron", 1), (1, "a moron twice", 1), (2, None, 0), (3, "", 0), (None, "moron", 1), (4, "all is well", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int").withColumns({"t": F.lit("x"), "id": F.lit(0)})
    labels = docs.select("doc_id", F.col("y").alias("toxic"))
    model = toxicity.train(docs, labels)
    assert toxicity.score(docs, model).count() == 6
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0


def test_quality_risk_by_hand():
    r = np.random.default_rng(3)
    xp, xu = r.normal(1.0, 1, (300, 3)), np.vstack([r.normal(1.0, 1, (200, 3)), r.normal(-1.0, 1, (200, 3))])
    assert abs(quality.best_bin_prior(xp.sum(axis=1), xu.sum(axis=1)) - 0.5) < 0.12
    prior, ridge = 0.5, 1e-4

    def risk(w):
        z = lambda x: x @ w[:-1] + w[-1]
        loss = lambda v: np.log1p(np.exp(-v)).mean()
        return prior * loss(z(xp)) + max(0.0, loss(-z(xu)) - prior * loss(-z(xp))) + ridge / 2 * (w[:-1] ** 2).sum()

    w = quality.fit(xp, xu, prior)
    assert risk(w) < risk(np.zeros(4))
    for _ in range(200):
        assert risk(w + 0.05 * r.normal(size=4)) > risk(w) - 1e-3
    h = 1e-5  # the gradient that one step follows, against differences of the risk
    v = np.array([0.1, -0.2, 0.05, 0.1])
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    a, b = np.hstack([xp, np.ones((300, 1))]), np.hstack([xu, np.ones((400, 1))])
    by_hand = b.T @ sigmoid(b @ v) / 400 - prior * (a.T @ sigmoid(a @ v)) / 300 - prior * (a.T @ sigmoid(-a @ v)) / 300 + ridge * np.append(v[:-1], 0)
    assert by_hand == pytest.approx([(risk(v + h * e) - risk(v - h * e)) / (2 * h) for e in np.eye(4)], abs=1e-6)


def test_quality_ties_and_odd_tables(spark):
    rows = [(i, "Good prose of a kind. It has words in it." if i % 2 else "### $$$ 1111 ||| ", i % 2) for i in range(80)] + [(None, None, 1), (7, "Good prose of a kind. It has words in it.", 1), (90, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int").withColumns({"x": F.lit(1), "h": F.lit(2), "score": F.lit(0.1)})
    got = quality.classify(docs, docs.select("doc_id", F.col("y").alias("quality"))).collect()
    assert len(got) == len(rows)
    good, bad = ({r.score for r in got if r.doc_id is not None and r.doc_id < 80 and r.doc_id % 2 == k} for k in (1, 0))
    assert len(good) == len(bad) == 1 and min(good) > max(bad)


PROSE = "<h1>A title of it</h1><p>The first paragraph has several words in it, and it goes on for a while to be long.</p><p>The second one is long, too, and says what the first one left out of its many words.</p>"


@pytest.fixture(scope="module")
def chain():
    return html_crf.default_chain()


@pytest.mark.parametrize("around", ["<article>|</article>", '<main class="related">|</main>', '<div class="hero-article">|</div>', "<table><tr><td>|</td></tr></table>", "|", '<div class="td-ss">|</div>', '<section class="prose">|</section>', '<div class="blog">|</div>', '<div id="wrapper"><div class="col-8">|</div></div>', '<div class="content"><noscript>|</noscript></div>', '<div class="content"><template>|</template></div>'])
def test_html_wrappers(chain, around):
    a, b = around.split("|")
    page = f"<html><head><title>t</title></head><body><nav><ul><li><a href=x>Home</a></li><li><a href=y>About</a></li></ul></nav>{a}{PROSE}{b}<footer>&copy; 2020 us</footer></body></html>"
    assert html_crf.main_text(page, chain) == "\n".join(re.findall(r">([^<]+)</(?:h1|p)>", PROSE))


def other_page(r):
    """A page of another make than the trained ones: English words, tables of links, news-like layout."""
    vocabulary = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also".split()
    words = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    sentence = lambda: words(r.randint(6, 18)).capitalize() + "."
    out, labels = ["<html><body>"], []

    def put(tag, text, main, attr=""):
        out.append(f"<{tag}{attr}>{text}</{tag}>")
        labels.append(main)

    out.append('<div class="navbar">')
    for _ in range(r.randint(3, 8)):
        put("li", f'<a href="#">{words(r.randint(1, 2))}</a>', False)
    out.append("</div>")
    out.append(r.choice(["<article>", '<div id="story">', "<main>", '<div class="x9">', '<section class="lead-in">']))
    close = re.match(r"<(\w+)", out[-1])[1]
    put("h1", words(r.randint(4, 9)).capitalize(), True)
    for _ in range(r.randint(3, 9)):
        put("p", " ".join(sentence() for _ in range(r.randint(2, 5))), True)
        if r.random() < 0.2:
            put("h2", words(3).capitalize(), True)
        if r.random() < 0.1:
            put("div", f'<a href="#">{words(4)}</a>', False, ' class="sponsored"')
    out.append(f"</{close}>")
    if r.random() < 0.6:
        out.append('<div id="comments">')
        for _ in range(r.randint(1, 4)):
            out.append('<div class="comment">')
            put("h4", words(1), False)
            put("p", " ".join(sentence() for _ in range(r.randint(1, 3))), False)
            out.append("</div>")
        out.append("</div>")
    out.append("<aside>")
    for _ in range(r.randint(1, 5)):
        put("p", f'<a href="#">{words(r.randint(3, 8))}</a>', False)
    out.append("</aside><footer>")
    put("p", f"&copy; 2021 {words(3)}", False)
    out.append("</footer></body></html>")
    return "".join(out), labels


def test_html_pages_of_another_make(chain):
    right = total = 0
    for k in range(200):
        page, labels = other_page(random.Random(k))
        found = html_crf.blocks(page)
        assert len(found) == len(labels)
        got = chain.decode(html_crf.features(found))
        right, total = right + sum(a == b for a, b in zip(got, labels, strict=True)), total + len(labels)
    assert right / total > 0.97, right / total


def test_html_all_labelings(chain):
    r = random.Random(1)
    for k in range(20):
        page = html_crf.features(html_crf.blocks(other_page(random.Random(k))[0]))[: r.randint(1, 9)]
        unary = [sum(chain.weights.get(x, 0.0) for x in f) for f in page]

        def value(y):
            return sum(u for u, v in zip(unary, y, strict=True) if v) + sum(chain.transitions[a, b] for a, b in zip(y, y[1:], strict=False))

        best = max(value(y) for y in itertools.product((0, 1), repeat=len(page)))
        assert value([int(v) for v in chain.decode(page)]) == pytest.approx(best)


def test_html_very_long_and_ties(chain):
    page = "<article>" + "<p>Some words that are said of it, and then again.</p>" * 20_000 + "</article>"
    assert html_crf.main_text(page, chain).count("\n") == 19_999
    assert html_crf.Chain({}, np.zeros((2, 2))).decode([["a"], ["b"]]) == [False, False]


def test_licenses_against_plain_cosine(spark):
    rows = [("LICENSE", "Released under the MIT License."), ("a/b/c.py", "print the sum of numbers"), ("a/NOTICE", "This work is licensed under the GNU General Public License, version 3."), ("a/x/LICENSE", "Released under the MIT License."), ("a/x/COPYING", "Released under the MIT License."), ("a/x/y/z.c", None), ("a/x/y/z.c", None), (None, ""), ("b/q.py", "w " * 100_000), ("b/r.py", "define main and run all of it\nLicensed under the Apache License, Version 2.0.\nreturn the sum of numbers to whoever calls it")]
    rows += [(f"hot/{i}.py", "nothing said") for i in range(50)]
    files = spark.createDataFrame(rows, "path string, text string").withColumns({"at": F.lit("x"), "dir": F.lit("y"), "n": F.lit(0), "stated": F.lit("s")})
    got = [(r.path, r.stated, r.inherited_from, r.license) for r in licenses.scan(files).collect()]
    texts = [t for _, t in rows]
    terms = [set(licenses.terms(t)) for t in texts if t]
    idf = lambda t: math.log((1 + len(rows)) / (1 + sum(t in x for x in terms))) + 1

    def unit(text):
        v = {t: (1 + math.log(n)) * idf(t) for t, n in licenses.Counter(licenses.terms(text)).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    def plain(text):
        lines = [unit(x) for x in text.split("\n") if licenses.terms(x)]
        best = max(((sum(x * unit(t).get(k, 0) for k, x in line.items()), name) for line in lines for name, ts in licenses.TEMPLATES.items() for t in ts), default=(0, None))
        return best[1] if best[0] >= licenses.NOTICE else None

    short = {t: plain(t) for t in set(texts) if t and len(t) < 200}
    stated = {(p, short.get(t)) for p, t in rows}
    assert {(p, s) for p, s, _, _ in got} == stated
    holders = {p.rsplit("/", 1)[0] if "/" in p else "": s for p, s in stated if p and s and licenses.LICENSE_FILE.match(p.rsplit("/", 1)[-1])}
    for path, s, origin, final in got:
        above = [] if path is None else ["/".join(path.split("/")[:k]) for k in range(path.count("/"), -1, -1)]
        nearest = next((d for d in above if d in holders), None)
        assert (origin, final) == (nearest, s or holders.get(nearest))


def test_decontamination_passes_agree(spark):
    r = random.Random(5)
    words = lambda n: " ".join(r.choice("abcdefghij") + r.choice("xyz") for _ in range(n))
    items = [(i, words(r.choice([3, 14, 40]))) for i in range(20)] + [(99, words(6000))]
    docs = [(i, words(30) + " " + r.choice(items)[1][: r.randint(20, 200)] + " " + words(20)) for i in range(30)] + [(50, items[-1][1]), (51, "x" * 500_000)]
    bench, texts = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    whole, parts = ([(x.doc_id, x.n_words, x.n_hit, x["items"], x.offsets) for x in decontam.contamination(texts, bench, keep=["doc_id"], most_nodes=n).orderBy("doc_id").collect()] for n in (1 << 20, 3000))
    assert whole == parts

    def brute(text):
        w, hit, found = text.split(), set(), set()
        for i, t in items:
            t = t.split()
            n = min(13, len(t))
            have = {tuple(t[k : k + n]) for k in range(len(t) - n + 1)}
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in have:
                    hit.update(range(k, k + n))
                    found.add(i)
        return len(w), len(hit), sorted(found)

    assert [(d, *brute(t)) for d, t in docs] == [x[:4] for x in whole]
    assert decontam.contamination(texts.limit(0), bench).count() == 0
    assert decontam.contamination(texts, bench.limit(0)).where("n_hit > 0").count() == 0


def test_chat_hot_and_long(spark):
    rows = [(1, None, f"s{i % 3}", f"text {i % 40}") for i in range(300)] + [(2, 5, "a", "x" * 200_000), (2, 5, "b", None), (2, 5, "b", "")]
    said = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"copies": F.lit(1), "mid": F.lit(2), "part": F.lit("p")})
    got = chat.rotate(said).collect()
    for conv in (1, 2):
        mine = sorted(((None, r, t) for c, _, r, t in rows if c == conv), key=lambda x: (x[1], x[2] is None, x[2] or ""))
        for who in {r for _, r, _ in mine}:
            seen = sorted((r for r in got if r.conv_id == conv and r.perspective == who), key=lambda r: r.seq)
            assert [r.seq for r in seen] == list(range(1, len(mine) + 1))
            whole = "".join(r.segment for r in seen)
            assert [whole[r.from_char : r.to_char] for r in seen] == [t or "" for _, _, t in mine]
            assert [r["mask"] for r in seen] == [r == who for _, r, _ in mine]


def test_scratch_is_dropped_and_shared_dir(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    before = set(map(id, common._OPEN))
    with common.finished():
        simhash.near_duplicates(docs).count()
        made = [x for x in common._OPEN if id(x) not in before]
        assert made
    assert not [x for x in common._OPEN if id(x) not in before]


def test_workers_keep_no_memory(spark):
    r = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join(r.choice("abcdefghijkl") * 3 for _ in range(2000))) for i in range(400)], "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(i, " ".join(f"{r.randrange(9999)}x" for _ in range(500))) for i in range(60)], "item_id long, text string")
    suffix.dedup_substrings(docs).count()
    decontam.contamination(docs, bench).count()

    def anonymous(batches):
        import pyarrow as pa

        for _ in batches:
            with open("/proc/self/smaps_rollup") as f:
                kb = int(re.search(r"\nPss_Anon:\s+(\d+)", f.read())[1])
            yield pa.RecordBatch.from_pydict({"kb": [kb]})

    assert max(x.kb for x in spark.range(0, 8, 1, 8).mapInArrow(anonymous, "kb long").collect()) < 150_000


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "  \n", "en", "a", 3), (3, "word " * 40_000, "de", None, 5), (4, "a b c d", "en", "b", 7), (4, "a b c d", "en", "b", 7), (5, None, None, "c", None), (TOP, "the last of all", "en", "c", 15), (None, "no id here", "en", "c", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    return docs.withColumns({name: F.lit(i) for i, name in enumerate(CLASHING)})


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_input(spark, odd_docs, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, odd_docs, SF)
    rows = out.collect()
    assert stage(spark, odd_docs.limit(0), SF).count() == 0
    if name == "mixing":
        assert len(rows) == 9 and all(r.taken <= 3 * r["size"] for r in rows)
        return
    assert out.schema.names == odd_docs.schema.names
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in rows)
    every = sorted((r.doc_id is None, r.doc_id or 0) for r in odd_docs.collect())
    # only near-duplicates go: of null, empty and blank texts one stays, and one of the repeated row
    assert ids == ([(False, 1), (False, 3), (False, 4), (False, TOP), (True, 0)] if name == "simhash" else every)
    assert all([r[c] for c in CLASHING] == list(range(len(CLASHING))) for r in rows)
    if name == "suffix_array":
        assert {r.doc_id: r.text for r in rows if r.doc_id}[3] == "word " * 40_000
