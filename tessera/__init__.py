"""Retrieval analytics over whole tables of questions and documents, on Spark."""

from tessera.config import EngineConfig
from tessera.functions.vectors import hash_embed
from tessera.operators.evaluate import per_question, self_check, summary, typed
from tessera.operators.fusion import fuse, rerank
from tessera.operators.index import Index, build, load, load_or_build
from tessera.operators.split import recursive, split, splitter
from tessera.plans.answer import contexts, invoke, prompt
from tessera.plans.retrieve import retrieve, retriever, similar
from tessera.sources.tables import read_pages, read_questions
from tessera.streaming.sync import answer_events, sync

__all__ = [
    "EngineConfig", "Index", "answer_events", "build", "contexts", "fuse", "hash_embed", "invoke", "load", "load_or_build", "per_question", "prompt", "read_pages", "read_questions",
    "recursive", "rerank", "retrieve", "retriever", "self_check", "similar", "split", "splitter", "summary", "sync", "typed",
]
