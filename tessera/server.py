"""The HTTP surface: GET /, GET /api/status, POST /api/search, POST /api/chat (server-sent events)."""

from __future__ import annotations

import dataclasses
import json
import re
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from tessera.config import MODES, EngineConfig
from tessera.operators import store
from tessera.operators.index import Index
from tessera.plans import answer
from tessera.plans.retrieve import api_rows, retrieve
from tessera.sources.tables import MOST_CANDIDATES, MOST_QUESTION, MOST_RRF_K, MOST_TOP_K
from tessera.streaming.sync import answer_events, sse

_ORIGIN = re.compile(r"null|https?://(localhost|127\.0\.0\.1|\[::1\])(:\d+)?")


def checked(body: dict, base: EngineConfig, top_k: int) -> tuple[str, EngineConfig, str]:
    """Question, settings and prompt variant of a request; what is out of bounds raises ValueError."""
    question = body.get("question") or body.get("query") or ""
    if not isinstance(question, str) or not 1 <= len(question) <= MOST_QUESTION:
        raise ValueError("question")
    given = {"top_k": body.get("top_k", top_k), "candidate_k": body.get("candidate_k", base.candidate_k), "rrf_k": body.get("rrf_k", base.rrf_k)}
    for name, most in (("top_k", MOST_TOP_K), ("candidate_k", MOST_CANDIDATES), ("rrf_k", MOST_RRF_K)):
        if not isinstance(given[name], int) or not 1 <= given[name] <= most:
            raise ValueError(name)
    mode, variant = body.get("retriever", base.mode), body.get("prompt_variant", "full")
    if mode not in MODES or variant not in answer.PROMPTS:
        raise ValueError("mode" if mode not in MODES else "prompt_variant")
    return question, dataclasses.replace(base, mode=mode, rerank=bool(body.get("rerank", base.rerank)), **given), variant


class Service:
    """What the handlers call; one request is a table of one question."""

    def __init__(self, spark: SparkSession, index: Index, config: EngineConfig, llm: answer.LanguageModel | None = answer.extractive):
        self.spark, self.index, self.config, self.llm = spark, index, config, llm

    def status(self) -> dict:
        rows = self.index.rows
        listed = store.status(rows).collect() if {"source", "page_label"} <= set(rows.columns) else []
        return {"ready": True, "chunks": self.index.about["count"], "dim": self.index.about["dim"], "index": self.index.about["index"], "llm": self.llm is not None, "defaults": dataclasses.asdict(self.config), "sources": [r.asDict() for r in listed]}

    def _found(self, question: str, config: EngineConfig) -> tuple:
        began = time.monotonic()
        q = self.spark.createDataFrame([(0, question)], "question_id long, question string")
        ranked = retrieve(q, self.index, config)
        rows = [r.asDict() for r in api_rows(ranked, self.index.rows).drop("question_id").orderBy("rank").collect()]
        return q, ranked, rows, round(1000 * (time.monotonic() - began), 1)

    def search(self, body: dict) -> dict:
        question, config, _ = checked(body, self.config, 5)
        _, _, rows, ms = self._found(question, config)
        return {"query": question, "retrieve_ms": ms, "score_kind": rows[0]["score_kind"] if rows else None, "results": rows}

    def chat(self, body: dict):
        question, config, variant = checked(body, self.config, 4)

        def events():
            q, ranked, rows, ms = self._found(question, config)
            said = answer.invoke(q, ranked, self.index.rows, self.llm, variant).first() if rows else None
            tokens = re.findall(r"\s*\S+", said.answer if said.branch == "no_model" else said.raw_answer) if said else ()
            yield from answer_events(rows, tokens, retrieve_ms=ms)

        return sse(events())


def server(spark: SparkSession, index: Index, config: EngineConfig, port: int = 8000, llm: answer.LanguageModel | None = answer.extractive) -> ThreadingHTTPServer:
    """A server on the loopback; scripts of pages from elsewhere aren't let in."""
    service = Service(spark, index, config, llm)

    class Handler(BaseHTTPRequestHandler):
        def _send(self, code: int, body, kind: str = "application/json") -> None:
            self.send_response(code)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            origin = self.headers.get("Origin")
            if origin and _ORIGIN.fullmatch(origin):
                self.send_header("Access-Control-Allow-Origin", origin)
            self.end_headers()
            for part in body if not isinstance(body, dict) else [json.dumps(body, ensure_ascii=False)]:
                self.wfile.write(part.encode())
                self.wfile.flush()

        def do_GET(self) -> None:
            if self.path == "/":
                self._send(200, ["tessera: GET /api/status, POST /api/search, POST /api/chat\n"], "text/plain")
            elif self.path == "/api/status":
                self._send(200, service.status())
            else:
                self._send(404, {"detail": "not found"})

        def do_POST(self) -> None:
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                if self.path == "/api/search":
                    self._send(200, service.search(body))
                elif self.path == "/api/chat":
                    self._send(200, service.chat(body), "text/event-stream")
                else:
                    self._send(404, {"detail": "not found"})
            except (ValueError, AttributeError) as bad:
                self._send(400, {"detail": str(bad)})

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
