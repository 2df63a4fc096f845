"""A question, end to end: one lazy plan from stored chunks to context, with two model calls around it."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.models.base import Answerer, Embedder, keywords, prompt
from lexiforge.operators import retrieval as r


@dataclass
class Settings:
    k: int = 40
    metric: str = "cosine"
    min_similarity: float = 0.2
    tag_min_similarity: float = 0.1
    tag_boost: float = 1.5
    source_boost: float = 1.0
    recency_boost: float = 1.0
    preferred: list[str] = field(default_factory=list)
    budget: int = 4096
    root: str = "/"


@dataclass
class Response:
    text: str = ""
    sources: list = field(default_factory=list)
    confidence: float = 0.0
    processing_time: float = 0.0
    error: str | None = None

    @property
    def success(self) -> bool:
        return self.error is None


def plan(rows: DataFrame, query: list[float], words: list[str], s: Settings, document=None, spec: dict | None = None, as_of: str | None = None) -> DataFrame:
    """The sources of a query, in order of place. rows: id, document, tags, embedding, and path or `document`."""
    hits = r.top_k(rows, query, s.k, s.metric, spec)
    sources = r.as_sources(hits, document if document is not None else r.relative(F.col("path"), s.root))
    date = "date" if "date" in rows.columns else None
    scored = r.hybrid_score(sources, words, s.preferred, s.tag_boost, s.source_boost, s.recency_boost, date, as_of)
    kept = r.filtered(r.best_of_document(scored), words, s.min_similarity, s.tag_min_similarity)
    return r.within_budget(kept, s.budget)


def ask(question: str, rows: DataFrame, embedder: Embedder, model: Answerer, settings: Settings | None = None, as_of: str | None = None) -> Response:
    """Answers a question; errors come back in the response."""
    began, s = time.monotonic(), settings or Settings()
    if not isinstance(question, str) or not question.strip():
        return Response(error="the question is empty")
    try:
        words = keywords(question)
        found = plan(rows, embedder.embed([question])[0], words, s, as_of=as_of).orderBy("place").collect()  # k rows at most
        context = "".join("\n---\n" + x.document for x in found)
        try:
            text = model.answer(prompt(question, context))
        except Exception:  # noqa: BLE001  a failing model leaves the answer empty
            text = ""
        return Response(text, found, found[0].similarity if found else 0.0, time.monotonic() - began)
    except Exception as e:  # noqa: BLE001
        return Response(error=str(e), processing_time=time.monotonic() - began)


def shown(response: Response) -> str:
    if response.error:
        return f"Error: {response.error}"
    return "\n".join([response.text, "", "Sources:", *(f"- {x.source_document} (similarity: {x.similarity:.2f})" for x in response.sources)])
