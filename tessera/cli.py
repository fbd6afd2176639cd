"""Command lines: index and ask, evaluate retrieval and answers, benchmark indexes, check question sets, fetch files, serve."""

from __future__ import annotations

import argparse
import os
import sys
import urllib.request
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import MODES, EngineConfig, parse_weights
from tessera.operators import evaluate, index, split
from tessera.operators import store as stored
from tessera.plans import answer, bench_index
from tessera.plans.retrieve import retrieve
from tessera.sinks import logger, merge_cache, read_cache, save_report, save_table
from tessera.sources import shared
from tessera.sources.tables import read_questions
from tessera.streaming.sync import sync


def session() -> SparkSession:
    return SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()


def opened(spark: SparkSession, args: argparse.Namespace) -> index.Index:
    """The index over the store of --store-dir, synchronised with --source first if that is given."""
    c = EngineConfig.from_env(index=args.index)
    if getattr(args, "source", None):
        made = lambda pages: split.split(pages, split.splitter(c), normalise=c.chunk_normalize)
        logger().info("synchronised: %s", sync(spark, args.source, args.store_dir, recreate=getattr(args, "recreate", False), make=made))
    rows = stored.load(spark, args.store_dir)
    if rows is None or not rows.limit(1).count():
        raise SystemExit("the store is empty: give --source")
    return index.load_or_build(spark, rows, f"{args.store_dir}/index", c, fingerprint=shared.fingerprint(rows))


def config(args: argparse.Namespace) -> EngineConfig:
    given = {"mode": args.retriever, "rerank": args.rerank, "index": args.index}
    given |= {k: v for k, v in (("top_k", args.top_k), ("candidate_k", args.candidate_k), ("rrf_k", args.rrf_k)) if v}
    if args.rrf_weight:
        w = parse_weights(args.rrf_weight)
        given |= {"vector_weight": w["vector"], "bm25_weight": w["bm25"]}
    return EngineConfig.from_env(**given)


def asked(spark: SparkSession, path: str) -> DataFrame:
    """A question set with numbers for ids, in the order of its ids."""
    q = read_questions(spark, path)
    ids = [r.id for r in q.select("id").orderBy("id").collect()]  # a stated question set
    return q.join(F.broadcast(spark.createDataFrame(list(enumerate(ids)), "question_id long, id string")), "id")


def ask(args: argparse.Namespace) -> int:
    """Answer --query, or every line of standard input (--chat), or only bring the index up to date (--reindex)."""
    spark = session()
    at = opened(spark, args)
    if args.reindex:
        print(f"{at.about['count']} rows, index {at.about['index']}, dimension {at.about['dim']}")
        return 0
    for line in [args.query] if args.query else sys.stdin:
        text = line.strip()
        if text in ("exit", "quit"):
            break
        q = spark.createDataFrame([(0, text)], "question_id long, question string")
        r = answer.invoke(q, retrieve(q, at, config(args)), at.rows).first()
        print(f"Answer: {r.answer}\nCitations: {r.citations.valid}/{r.citations['count']} valid, of {list(r.citations.cited_sources)}")
    return 0


def run_eval(args: argparse.Namespace) -> int:
    spark = session()
    at, questions = opened(spark, args), asked(spark, args.questions)
    docs = at.rows
    covered = evaluate.coverage(questions, docs)
    ranked = retrieve(questions, at, config(args))
    seconds = bench_index.timed(lambda: ranked.write.format("noop").mode("overwrite").save(), 1)
    if args.judge:
        pairs = ranked.join(questions.select("question_id", "question"), "question_id").join(docs.select("doc_idx", F.col("page_content").alias("text")), "doc_idx")
        judged, fresh = answer.relevance(pairs, read_cache(spark, args.judge_cache))
        print(f"{judged.where('verdict').count()} of {judged.count()} passages are relevant; {merge_cache(spark, args.judge_cache, fresh)} replies are new")
    rows = evaluate.per_question(questions.join(covered, "question_id"), ranked, docs)
    summary = evaluate.summary(rows).withColumn("ms_per_question", F.round(F.lit(1000 * seconds) / F.greatest("total", F.lit(1)), 1))
    summary.show(truncate=False)
    evaluate.type_counts(questions).show()
    evaluate.reports(rows).show(1000, truncate=False)
    if args.detail:
        rows.orderBy("question_id").show(1000, truncate=False)
    if args.save:
        save_report(args.save, summary, rows)
    return 0


def run_gen_eval(args: argparse.Namespace) -> int:
    spark = session()
    at = opened(spark, args)
    questions = evaluate.chosen(asked(spark, args.questions), args.only_type, args.limit)
    answers = answer.invoke(questions, retrieve(questions, at, config(args)), at.rows, variant=args.prompt_variant)
    judged, fresh = answer.faithfulness(answers.where("not refused").select("question_id", "answer", "context"), read_cache(spark, args.judge_cache))
    if args.judge:
        merge_cache(spark, args.judge_cache, fresh)
    rows = answer.generation_rows(answers, questions, judged)
    summary, by_type = evaluate.generation(rows), evaluate.generation(rows, by_type=True)
    summary.show(truncate=False)
    by_type.show(truncate=False)
    if args.detail:
        answers.select("question_id", "branch", F.substring("answer", 1, 160).alias("answer")).orderBy("question_id").show(1000, truncate=False)
    save_report(args.save or f"results/gen_{args.prompt_variant}.json", summary, rows, by_type)
    return 0


def bench_ann(args: argparse.Namespace) -> int:
    spark = session()
    rows = stored.load(spark, args.store_dir) if args.mode == "corpus" else None
    print(save_table(args.out, bench_index.benchmark(spark, [int(x) for x in args.sizes.split(",")], queries=args.queries, k=args.k, repeats=args.repeats, stored=rows)))
    return 0


def check_questions(args: argparse.Namespace) -> int:
    """1 if any question of the set has a finding."""
    spark = session()
    rows = stored.load(spark, args.store_dir)
    found = evaluate.self_check(asked(spark, args.questions), rows).orderBy("question_id")
    found.show(1000, truncate=False)
    return int(found.where("verdict not in ('OK', 'SKIPPED')").limit(1).count() > 0)


def fetch(urls: list[str], folder: str, mirror: str = "", force: bool = False, opener=urllib.request.urlopen) -> int:
    """Download PDFs: to a ``.part`` file first, put in place only if it begins as a PDF does; returns how many came."""
    done = 0
    for url in urls:
        target = Path(folder) / url.rsplit("/", 1)[-1]
        if target.exists() and not force:
            continue
        target.parent.mkdir(parents=True, exist_ok=True)
        part = target.with_name(target.name + ".part")
        with opener(mirror + url) as reply:
            part.write_bytes(reply.read())
        if part.read_bytes()[:5] != b"%PDF-":
            part.unlink()
            logger().warning("%s is no PDF", url)
            continue
        os.replace(part, target)
        done += 1
    return done


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, retrieval: bool = False) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=(run.__doc__ or name).split("\n")[0])
        p.set_defaults(run=run)
        p.add_argument("--store-dir", default="vector_store")
        p.add_argument("--index", "--faiss-index-type", default="exact", choices=sorted(index.BACKENDS))
        if retrieval:
            p.add_argument("--retriever", default="hybrid", choices=MODES)
            p.add_argument("--rerank", action=argparse.BooleanOptionalAction, default=False)
            for flag in ("--top-k", "--candidate-k", "--rrf-k"):
                p.add_argument(flag, type=int)
            p.add_argument("--rrf-weight")
        return p

    p = command("ask", ask, True)
    p.add_argument("--source", help="folder of files to take up")
    p.add_argument("--query")
    for flag in ("--recreate", "--reindex", "--chat"):
        p.add_argument(flag, action="store_true")
    for name, run in (("eval", run_eval), ("gen-eval", run_gen_eval)):
        p = command(name, run, True)
        p.add_argument("--questions", required=True)
        p.add_argument("--judge", action="store_true")
        p.add_argument("--judge-cache", default="judge_cache")
        p.add_argument("--detail", action="store_true")
        p.add_argument("--save")
        if name == "gen-eval":
            p.add_argument("--limit", type=int)
            p.add_argument("--only-type")
            p.add_argument("--prompt-variant", default="full", choices=sorted(answer.PROMPTS))
    p = command("bench-ann", bench_ann)
    p.add_argument("--mode", default="synth", choices=("synth", "corpus"))
    p.add_argument("--sizes", default="2000,20000")
    for flag, n in (("--queries", 20), ("--k", 4), ("--repeats", 3)):
        p.add_argument(flag, type=int, default=n)
    p.add_argument("--out", default="ann_benchmark.json")
    p = command("check-questions", check_questions)
    p.add_argument("--questions", required=True)
    p = command("fetch", lambda a: 0 if fetch(a.urls, a.folder, a.mirror, a.force) >= 0 else 1)
    p.add_argument("urls", nargs="*")
    p.add_argument("--folder", default="pdfs")
    p.add_argument("--mirror", default="")
    p.add_argument("--force", action="store_true")
    p = command("serve", serve, True)
    p.add_argument("--port", type=int, default=8000)
    return top


def serve(args: argparse.Namespace) -> int:
    from tessera.server import server

    spark = session()
    with server(spark, opened(spark, args), config(args), args.port) as s:
        s.serve_forever()
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "ask" and not (args.query or args.chat or args.reindex):
        parser().print_help()
        return 1
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
