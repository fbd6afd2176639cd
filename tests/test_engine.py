"""Rules of the engine by hand-written cases."""

import contextlib
import io
import json
import random
import threading
import urllib.error
import urllib.request

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera import cli, sinks
from tessera.config import EngineConfig, parse_weights
from tessera.functions import text as T
from tessera.functions.vectors import hash_embed
from tessera.operators import dense, evaluate, fusion, index, sparse, split, store
from tessera.plans import answer, bench_index
from tessera.plans.retrieve import retrieve, similar
from tessera.server import server
from tessera.sources.tables import invented_vectors, noisy_copies, read_legacy_index, read_pages, read_questions
from tessera.streaming.sync import answer_events, masked, masked_tokens, sse, sync, watch


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<struct<file:string,page:string>>' if k == 'keys' else 'string'}" for k in values)).select(column).first()[0]


def test_config():
    assert EngineConfig(top_k=80).candidate_k == 80
    with pytest.raises(ValueError):
        EngineConfig(mode="other")
    assert parse_weights("1，2") == {"vector": 1.0, "bm25": 2.0}
    with pytest.raises(ValueError):
        parse_weights("1")


def test_citations(spark):
    t = "x [来源: a.pdf 第03页] y【来源：b.pdf 第12页】"
    assert [tuple(r) for r in one(spark, T.citations("t"), t=t)] == [("a.pdf", "3"), ("b.pdf", "12")]
    r = one(spark, T.citation_report("t", "keys"), t=t, keys=[("a.pdf", "3")])
    assert (r["count"], r.valid, r.validity, r.cited_sources) == (2, 1, 0.5, ["a.pdf"])
    assert one(spark, T.citation_report("t", "keys"), t="none", keys=[("a.pdf", "3")]).validity is None


def test_refusals(spark):
    state = lambda t: tuple(one(spark, T.refusal_state("t"), t=t))
    assert state("INSUFFICIENT_CONTEXT") == (True, False)
    assert state("短 未说明") == (True, False)
    assert state("y" * 120 + "未给出") == (False, True)
    assert state("资料未提及" + "x" * 120) == (True, True)
    assert state(None) == (False, False)


def test_judge_replies(spark):
    assert tuple(one(spark, T.verdict("t"), t="yes | good")) == (True, "good")
    assert tuple(one(spark, T.verdict("t"), t="否，不相关")) == (False, "不相关")
    c = one(spark, T.claims("t"), t='x {"claims": [{"claim": "a", "supported": true}, {"claim": "b", "supported": false}]} y')
    assert (c.total, c.supported, c.score, c.parse_failed) == (2, 1, 0.5, False)
    assert one(spark, T.claims("t"), t="{broken").parse_failed


def test_fusion_values(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 20, 2)], "question_id long, doc_idx long, rank long")
    b = spark.createDataFrame([(1, 20, 5)], "question_id long, doc_idx long, rank long")
    got = {r.doc_idx: (r.score, r.vector_rank, r.bm25_rank) for r in fusion.fuse({"vector": a, "bm25": b}).collect()}
    assert got == {10: (round(1 / 61, 9), 1, None), 20: (round(1 / 62 + 1 / 65, 9), 2, 5)}


def test_retrieve_modes_and_empty(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, "")], "doc_idx long, page_content string")
    asked = spark.createDataFrame([(7, "beta beta")], "question_id long, question string")
    hit = retrieve(asked, docs, EngineConfig(mode="bm25")).collect()
    assert [(r.doc_idx, r.score_kind) for r in hit] == [(1, "bm25")]
    assert retrieve(asked, docs, EngineConfig(mode="vector", top_k=2)).count() == 2
    assert retrieve(asked, docs.limit(0)).count() == 0
    assert retrieve(asked.limit(0), docs).count() == 0
    assert retrieve(asked, docs, EngineConfig(rerank=True)).first().score_kind == "rerank"


def test_threshold_is_after_top_k(spark):
    v = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "doc_idx long, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "question_id long, embedding array<double>")
    assert [r.doc_idx for r in dense.exact(q, v, 2, threshold=0.9).collect()] == [0]
    assert dense.recall(dense.exact(q, v, 2), dense.exact(q, v, 2)).first().recall == 1.0


@settings(max_examples=60, deadline=None)
@given(st.text("ab .\n", max_size=300), st.integers(10, 60))
def test_recursive_split(t, size):
    for at, chunk in split.recursive(t, size, size // 4):
        assert t[at : at + len(chunk)] == chunk and len(chunk) <= size


def test_paragraphs(spark):
    folded = lambda t: one(spark, split.paragraphs(F.col("t")), t=t)
    long, more = "a line that is long enough to join", "another line that is long enough."
    assert folded(f"{long}\n{more}\n\n\n\nshort\nEnd") == f"{long} {more}\n\nshort\nEnd"
    assert folded("a line that is long and ends in a hy-\nphen that is long enough, too") == "a line that is long and ends in a hyphen that is long enough, too"
    wide = "中文的一行它足够长可以与下一行连接起来没有标点"
    assert folded(f"{wide}\r\n{wide}") == wide * 2 and folded(f"{wide}。\n{wide}") == f"{wide}。\n{wide}"
    assert folded(f"{long}\n1. {more}") == f"{long}\n1. {more}" and folded(None) == "" and folded(" \n\n ") == ""


def test_tokenizer(spark):
    assert one(spark, T.tokens("t"), t="Spark中文测试 a中b") == ["spark", "中文", "文测", "测试", "a", "中", "b"]
    assert one(spark, T.tokens("t"), t=None) == []
    docs = spark.createDataFrame([(1, "向量检索很快"), (2, "别的文字")], "doc_idx long, page_content string")
    asked = spark.createDataFrame([(7, "检索")], "question_id long, question string")
    assert [r.doc_idx for r in retrieve(asked, docs, EngineConfig(mode="bm25")).collect()] == [1]
    signs = lambda t: F.filter(F.split(F.col(t) if isinstance(t, str) else t, ""), lambda x: x != "")
    assert retrieve(asked, docs, EngineConfig(mode="bm25"), tokenizer=signs).count() == 1


def test_token_unit():
    text = "one two three. " * 100
    found = split.splitter(EngineConfig(chunk_size=40, chunk_overlap=8))(text)
    assert all(split.token_count(c) <= 40 and text[at : at + len(c)] == c for at, c in found) and len(found) > 5
    assert all(len(c) <= 40 for _, c in split.splitter(EngineConfig(chunk_unit="char", chunk_size=40, chunk_overlap=8))(text))
    assert split.splitter(EngineConfig(chunk_size=5, chunk_overlap=1), length=lambda t: 1)(text)[0][1] == text.strip()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["INSUFF", "ICIENT_", "CONTEXT", " ", "x"]), max_size=6))
def test_masking(tokens):
    said = "".join(tokens)
    refused = said.lstrip().startswith(T.SENTINEL)
    assert "".join(masked(tokens)) == ("" if refused else said)


def test_store(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_idx long, page_content string")
    path = str(tmp_path / "s")
    assert not store.exists(spark, path)
    assert store.add(spark, docs, path, model="m") == 2
    assert store.add(spark, docs, path, model="m") == 0
    assert not store.needs_rebuild(spark, path, model="m") and store.needs_rebuild(spark, path, model="n")
    assert store.add(spark, docs.limit(0), str(tmp_path / "e")) == 0


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"one\r\ntwo\fthree")
    (tmp_path / "in" / "b.txt").write_bytes(b"\xff")
    rows = read_pages(spark, str(tmp_path / "in")).orderBy("page").collect()
    assert [(r.page_label, r.page_content) for r in rows] == [("1", "one\ntwo"), ("2", "three")]
    assert read_pages(spark, str(tmp_path / "in"), on_error="keep").where("error is not null").count() == 1
    for body in ([{"id": "x", "question": "q"}], {"questions": [{"id": "x", "question": "q", "type": "multi_hop"}]}):
        (tmp_path / "q.json").write_text(json.dumps(body))
        assert read_questions(spark, str(tmp_path / "q.json")).count() == 1


def test_sync(spark, tmp_path):
    folder, path = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    (folder / "b.txt").write_bytes(b"two\fthree")
    (folder / "a.txt").write_bytes(b"one\ftwo")
    assert sync(spark, str(folder), path) == {"new": 2, "changed": 0, "same": 0, "removed": 0, "added": 3}
    assert {r.page_content: r.name for r in store.load(spark, path).collect()} == {"one": "a.txt", "two": "a.txt", "three": "b.txt"}
    assert sync(spark, str(folder), path)["added"] == 0
    (folder / "a.txt").write_bytes(b"one\fnew")
    assert sync(spark, str(folder), path) == {"new": 0, "changed": 1, "same": 1, "removed": 0, "added": 1}
    assert {r.page_content for r in store.load(spark, path).collect()} == {"one", "two", "three", "new"}
    (folder / "b.txt").unlink()
    assert sync(spark, str(folder), path, prune=True)["removed"] == 1
    assert {r.page_content for r in store.load(spark, path).collect()} == {"one", "new"} and store.manifest(spark, path)["count"] == 2
    (folder / "c.txt").write_bytes(b"late")
    for _ in range(2):
        watch(spark, str(folder), path, str(tmp_path / "cp"))
    assert store.load(spark, path).count() == 3
    cut = lambda pages: split.split(pages, split.windows)
    assert sync(spark, str(folder), str(tmp_path / "other"), make=cut)["added"] == 3


def test_index(spark, tmp_path):
    r = random.Random(0)
    words = [f"w{i}" for i in range(300)]
    docs = spark.createDataFrame([(i, " ".join(r.choices(words, k=30)) if i % 50 else "") for i in range(400)], "doc_idx long, page_content string")
    asked = spark.createDataFrame([(i, " ".join(r.choices(words, k=5))) for i in range(20)], "question_id long, question string")
    rows = lambda df: sorted(map(str, df.collect()))
    at = index.build(spark, docs, str(tmp_path / "x"))
    for mode in ("bm25", "vector", "hybrid"):
        assert rows(retrieve(asked, at, EngineConfig(mode=mode))) == rows(retrieve(asked, docs, EngineConfig(mode=mode)))
    found = retrieve(asked, at)
    both = found.select("question_id", "doc_idx").join(found.where("doc_idx % 2 = 0").select("question_id", "doc_idx", F.lit(1).alias("even")), ["question_id", "doc_idx"], "left")
    assert both.where("even is null and doc_idx % 2 = 0").count() == 0
    assert index.load_or_build(spark, docs, str(tmp_path / "y"), mark="1").about["mark"] == "1"
    made = (tmp_path / "y" / "manifest").stat().st_mtime_ns
    assert index.load_or_build(spark, docs, str(tmp_path / "y"), mark="1").about["count"] == 400 and (tmp_path / "y" / "manifest").stat().st_mtime_ns == made
    assert index.load_or_build(spark, docs.limit(50), str(tmp_path / "y"), mark="2").about["count"] == 50
    queries = hash_embed(asked, "question").select("question_id", "embedding")
    exact = at.vectors(queries, 5)
    for name, all_of_it in (("ivf", 400), ("hash", 1 << 14)):
        other = index.build(spark, docs, str(tmp_path / name), EngineConfig(index=name, nlist=16))
        assert rows(other.vectors(queries, 5, all_of_it)) == rows(exact)
        assert dense.recall(exact, other.vectors(queries, 5, 2)).first().recall <= 1.0
        more = index.add(spark, spark.createDataFrame([(900, "w1 w2 w3"), (3, "is there")], "doc_idx long, page_content string"), str(tmp_path / name))
        assert more.about["count"] == 401 and more.rows.where("doc_idx = 900").count() == 1 and more.cells.where("doc_idx = 900").count() > 0
    empty = index.build(spark, docs.limit(0), str(tmp_path / "none"), EngineConfig(index="ivf"))
    assert retrieve(asked, empty).count() == 0 and similar(queries, empty).count() == 0
    assert similar(queries, at, EngineConfig(score_threshold=2.0)).count() == 0
    with pytest.raises(ValueError):
        index.resolve("tree")
    with pytest.raises(FileNotFoundError):
        index.load(spark, str(tmp_path / "nothing"))


def test_answers(spark):
    docs = spark.createDataFrame([(1, "alpha beta. gamma", "d/a.txt", 0, "1")], "doc_idx long, page_content string, source string, page int, page_label string")
    asked = spark.createDataFrame([(1, "alpha"), (2, ""), (3, "nothing of it"), (4, None)], "question_id long, question string")
    ranked = retrieve(asked, docs, EngineConfig(mode="bm25"))
    got = {r.question_id: r for r in answer.invoke(asked, ranked, docs).collect()}
    assert {k: r.branch for k, r in got.items()} == {1: "answered", 2: "no_question", 3: "no_documents", 4: "no_question"}
    assert got[1].citations.valid == 1 and got[3].raw_answer == T.SENTINEL and got[3].refused
    refused = answer.invoke(asked, ranked, docs, answer.model(lambda: lambda p: T.SENTINEL)).where("question_id = 1").first()
    assert (refused.branch, refused.answer, refused.citations["count"]) == ("refused", answer.REFUSED, 0)

    def broken():
        def client(p):
            raise OSError

        return client

    assert answer.invoke(asked, ranked, docs, answer.model(broken, "failed")).where("question_id = 1").first().answer == "failed"
    assert answer.invoke(asked, ranked, docs, None).where("question_id = 1").first().branch == "no_model"
    with pytest.raises(ValueError):
        answer.invoke(asked, ranked, docs, variant="loud")


def test_judges_and_cache(spark, tmp_path):
    pairs = spark.createDataFrame([(1, "a b", "a b c"), (2, "x", "y"), (3, "long", "z" * 1200 + " long")], "i long, question string, text string")
    path = str(tmp_path / "cache")
    judged, fresh = answer.relevance(pairs, sinks.read_cache(spark, path))
    assert {r.i: r.verdict for r in judged.collect()} == {1: True, 2: False, 3: False}
    assert sinks.merge_cache(spark, path, fresh) == 3 and sinks.merge_cache(spark, path, fresh) == 0
    again, none = answer.relevance(pairs, sinks.read_cache(spark, path), lambda q, t: F.lit(None).cast("string"))
    assert none.count() == 0 and again.where("verdict").count() == 1
    said = spark.createDataFrame([(1, "One is so. Two is not.", "One is so, they say")], "i long, answer string, context string")
    claims, _ = answer.faithfulness(said, sinks.read_cache(spark, str(tmp_path / "f")))
    assert tuple(claims.first().claims) == (2, 1, 0.5, False)
    broken, _ = answer.faithfulness(said, sinks.read_cache(spark, str(tmp_path / "f")), lambda a, c: F.lit("no json"))
    assert tuple(broken.first().claims) == (0, 0, None, True)


def test_rerank_by_model(spark):
    docs = spark.createDataFrame([(1, "short"), (2, "a longer text")], "doc_idx long, page_content string")
    asked = spark.createDataFrame([(7, "short longer")], "question_id long, question string")
    by_length = fusion.model_scorer(lambda: lambda q, t: [float(len(x)) for x in t])
    assert [r.doc_idx for r in retrieve(asked, docs, EngineConfig(rerank=True), scorer=by_length).orderBy("rank").collect()] == [2, 1]


def test_events_and_transport():
    events = list(answer_events([{"source": "a"}], ["So ", "it is."], retrieve_ms=2.0))
    assert [e["type"] for e in events] == ["sources", "token", "token", "done"] and events[-1]["answer"] == "So it is."
    assert [e["type"] for e in answer_events([{"source": "a"}], ["INSUFFICIENT_", "CONTEXT"])] == ["sources", "done"]
    assert list(answer_events([], iter(())))[-1]["refused"]
    sent = list(sse(answer_events([{"source": "a"}], ["x"], retrieve_ms=2.0)))
    assert all(x.startswith("data: {") and x.endswith("\n\n") for x in sent) and "total_ms" in sent[-1]

    def failing():
        yield {"type": "token", "text": "x"}
        raise OSError("gone")

    assert json.loads(list(sse(failing()))[-1][6:]) == {"type": "error", "message": "gone"}


@settings(max_examples=20, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["INSUFF", "ICIENT_", "CONTEXT", " ", "x", ""]), max_size=6), min_size=1, max_size=8))
def test_masking_column(spark, streams):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(streams)], "i long, t array<string>").select("i", masked_tokens(F.col("t")).alias("s")).collect()
    assert {r.i: [x for x in r.s if x] for r in rows} == {i: [x for x in masked(t) if x] for i, t in enumerate(streams)}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "MISS"), (2, "HIT@1")], "question_id long, status string")
    sinks.save_report(str(tmp_path / "r" / "e.json"), rows.agg(F.count("*").alias("total")), rows, rows.groupBy("status").count())
    saved = json.loads((tmp_path / "r" / "e.json").read_text())
    assert saved["summary"] == {"total": 2} and [r["question_id"] for r in saved["per_question"]] == [1, 2] and len(saved["by_type"]) == 2
    legacy = spark.createDataFrame([("t", "s", 1, [0.5, 0.5])], "page_content string, source string, page int, embedding array<float>")
    sinks.save_legacy(str(tmp_path / "old.json"), legacy)
    back = read_legacy_index(spark, str(tmp_path / "old.json")).first()
    assert (back.page_content, back.source, back.page, list(back.embedding)) == ("t", "s", 1, [0.5, 0.5])
    assert "n  x" in sinks.save_table(str(tmp_path / "b.json"), [{"n": 1, "x": 0.5}]).splitlines()[0]
    assert sinks.logger("tessera.test") is sinks.logger("tessera.test") and len(sinks.logger("tessera.test").handlers) == 1
    with pytest.raises(ValueError):
        store.add(spark, spark.createDataFrame([(1, "a", None)], "doc_idx long, page_content string, embedding array<float>"), str(tmp_path / "m"))


def test_invented_vectors_and_benchmark(spark, tmp_path):
    a, b = (invented_vectors(spark.newSession() if k else spark, 30, 8) for k in (0, 1))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.repartition(7).collect()))
    copies = noisy_copies(a, 70).collect()
    assert len(copies) == 70 and all(abs(sum(x * x for x in r.embedding) - 1) < 1e-9 for r in copies)
    rows = bench_index.benchmark(spark, [200], dim=8, queries=5)
    assert [r["method"] for r in rows[:1]] == ["exact"] and rows[0]["recall_at_k"] == 1.0 and {r["method"] for r in rows} == {"exact", "ivf", "hash"}
    assert not any(r["param"] == "nprobe=32" for r in rows)


def test_command_line(spark, tmp_path, capsys):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("alpha beta gamma\fdelta epsilon " + "and more of it " * 20)
    at = ["--store-dir", str(tmp_path / "store")]
    assert cli.main(["ask", *at]) == 1
    assert cli.main(["ask", *at, "--source", str(folder), "--query", "alpha gamma"]) == 0
    assert "[来源: a.txt 第1页]" in capsys.readouterr().out
    (tmp_path / "q.json").write_text(json.dumps([{"id": "a", "question": "alpha beta", "expected_keywords": ["gamma"], "expected_source": "a.txt"}, {"id": "b", "question": "zeta", "type": "no_answer", "absent_terms": ["zeta"]}]))
    assert cli.main(["eval", *at, "--questions", str(tmp_path / "q.json"), "--save", str(tmp_path / "e.json"), "--rrf-weight", "1,2", "--judge", "--judge-cache", str(tmp_path / "jc")]) == 0
    assert json.loads((tmp_path / "e.json").read_text())["summary"]["hit_at_1"] == 1.0
    assert cli.main(["gen-eval", *at, "--questions", str(tmp_path / "q.json"), "--save", str(tmp_path / "g.json"), "--only-type", "single_fact"]) == 0
    assert json.loads((tmp_path / "g.json").read_text())["summary"]["answered"] == 1
    assert cli.main(["check-questions", *at, "--questions", str(tmp_path / "q.json")]) == 1
    with pytest.raises(SystemExit):
        cli.main(["ask", "--retriever", "other"])
    bodies = {"http://h/x.pdf": b"%PDF-1.7 body", "http://h/y.pdf": b"<html>"}
    opened = lambda url: contextlib.closing(io.BytesIO(bodies[url]))
    assert cli.fetch(list(bodies), str(tmp_path / "pdfs"), opener=opened) == 1 and cli.fetch(list(bodies)[:1], str(tmp_path / "pdfs"), opener=opened) == 0
    assert sorted(p.name for p in (tmp_path / "pdfs").iterdir()) == ["x.pdf"]


def test_server(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta", "d/a.txt", 0, "1"), (2, "gamma", "d/b.txt", 0, "1")], "doc_idx long, page_content string, source string, page int, page_label string")
    with server(spark, index.build(spark, docs, str(tmp_path / "x")), EngineConfig(), 0) as s:
        threading.Thread(target=s.serve_forever, daemon=True).start()
        at = f"http://127.0.0.1:{s.server_address[1]}"

        def ask(path, body=None, origin="http://localhost:3000"):
            r = urllib.request.Request(at + path, None if body is None else json.dumps(body).encode(), {"Origin": origin})
            with urllib.request.urlopen(r) as reply:
                return reply.read().decode(), reply.headers

        text, headers = ask("/api/status")
        assert json.loads(text)["chunks"] == 2 and headers["Access-Control-Allow-Origin"] == "http://localhost:3000"
        assert ask("/api/status", origin="http://elsewhere.example")[1]["Access-Control-Allow-Origin"] is None
        found = json.loads(ask("/api/search", {"query": "alpha", "top_k": 1})[0])
        assert found["score_kind"] == "rrf" and found["results"][0]["source"] == "a.txt"
        kinds = [json.loads(x[6:])["type"] for x in ask("/api/chat", {"question": "alpha"})[0].split("\n\n") if x]
        assert kinds[0] == "sources" and kinds[-1] == "done" and "token" in kinds
        for bad in ({"question": ""}, {"question": "x" * 501}, {"question": "x", "top_k": 21}, {"question": "x", "retriever": "other"}, {"question": "x", "prompt_variant": "loud"}):
            with pytest.raises(urllib.error.HTTPError) as failed:
                ask("/api/search", bad)
            assert failed.value.code == 400
        s.shutdown()


def test_self_check_rules(spark):
    docs = spark.createDataFrame([(1, "s", "the word here " * 20), (2, "t", "other text")], "doc_idx long, source string, page_content string")
    rows = [(1, "single_fact", ["WORD"], "s", None), (2, "no_answer", [], None, ["other"]), (3, "no_answer", [], None, ["absent"]), (4, "multi_hop", [], None, None), (5, "single_fact", ["word"], "t", None), (6, "single_fact", ["none"], "t", None)]
    asked = spark.createDataFrame(rows, "question_id long, type string, expected_keywords array<string>, expected_source string, absent_terms array<string>")
    assert {r.question_id: r.verdict for r in evaluate.self_check(asked, docs).collect()} == {1: "OK", 2: "NOT_ABSENT", 3: "OK", 4: "SKIPPED", 5: "SOURCE_ZERO", 6: "NO_BODY_HIT"}


def test_prompts(spark):
    c, version = answer.prompt(F.lit("Q?"), F.lit("C"), "no_cite")
    assert version == "v1-nocite" and "Q?" in spark.range(1).select(c).first()[0]
    with pytest.raises(ValueError):
        answer.prompt(F.lit(""), F.lit(""), "x")


def test_bm25_counts_empty_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_idx long, page_content string")
    assert tuple(sparse.statistics(docs).first()) == (2, 1.0)
