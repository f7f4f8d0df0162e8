"""Calling models for many rows: in batches, with deadlines, failing open, and through a cache.

A provider is any object with the methods below. What a call can't get is null, and the rows of other calls
are not touched by it. A task has so many calls in flight at most, waits for none longer than its deadline, and makes
no more of them after so many have failed in a row. No network code is part of the library.
"""

from __future__ import annotations

import json
import queue
import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import l2_normalized, norm
from tessera.operators import catalog

#: Texts in one call.
BATCH = 32


class Provider(Protocol):
    def embed(self, texts: list[str]) -> list[dict]:
        """One ``{"index": place, "embedding": vector}`` for each text, in any order."""

    def rerank(self, query: str, documents: list[str]) -> list[dict]:
        """``{"index": place, "score": number}`` for the documents it can tell of."""

    def complete(self, prompt: str) -> str:
        """An answer."""


@dataclass(frozen=True)
class Limits:
    #: Seconds that a call may take; calls of one task at a time; failed calls in a row after which none is made; texts in a call.
    deadline: float = 30.0
    in_flight: int = 4
    give_up_after: int = 3
    batch: int = BATCH


def called(calls: Iterable[Callable[[], Any]], limits: Limits = Limits()) -> Iterator[tuple[Any, str | None]]:
    """The answer or the error of each call, in order.

    A call that is past its deadline is left to itself (its thread ends with the worker) and counts as failed. So many
    failures in a row end it: what is left gets an error without being called.
    """
    waiting: deque[tuple[queue.SimpleQueue, float]] = deque()
    failed, rest = 0, iter(calls)

    def begun() -> bool:
        call = next(rest, None)
        if call is None:
            return False
        answer: queue.SimpleQueue = queue.SimpleQueue()

        def run() -> None:
            try:
                answer.put((call(), None))
            except Exception as e:  # noqa: BLE001  whatever a provider raises costs its call alone
                answer.put((None, f"{type(e).__name__}: {e}"))

        threading.Thread(target=run, daemon=True).start()
        waiting.append((answer, time.monotonic() + limits.deadline))
        return True

    while True:
        while failed < limits.give_up_after and len(waiting) < limits.in_flight and begun():
            pass
        if not waiting:
            break
        answer, until = waiting.popleft()
        try:
            found = answer.get(timeout=max(until - time.monotonic(), 0.001))
        except queue.Empty:
            found = (None, f"TimeoutError: no answer in {limits.deadline} s")
        failed = failed + 1 if found[1] else 0
        yield found
    for _ in rest:
        yield None, f"not called: {failed} calls failed before"


def by_index(answers: Column) -> Column:
    """The embeddings of an answer (array of index, embedding) in the order of what was asked."""
    return F.transform(F.array_sort(answers), lambda a: a["embedding"])


def embedded(rows: DataFrame, provider: Provider, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows with ``embedding``, of unit length, and ``failed``, the error where there is none."""
    names = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors, errors = [None] * len(pdf), [None] * len(pdf)
            texts = pdf[text].tolist()
            spans = [range(at, min(at + limits.batch, len(texts))) for at in range(0, len(texts), limits.batch)]
            asked = [some for some in ([i for i in span if texts[i]] for span in spans) if some]
            answers = called((lambda some=some: provider.embed([texts[i] for i in some]) for some in asked), limits)
            for some, (answer, error) in zip(asked, answers, strict=True):
                try:
                    placed = {some[a["index"]]: [float(x) for x in a["embedding"]] for a in answer or []}
                except Exception as e:  # noqa: BLE001  an answer that can't be read is a failed call
                    placed, error = {}, f"{type(e).__name__}: {e}"
                for i in some:
                    vectors[i], errors[i] = placed.get(i), error
            yield pdf[names].assign(__vector=vectors, failed=errors)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    made = rows.mapInPandas(run, f"{kinds}, __vector array<double>, failed string")
    unit = l2_normalized(F.col("__vector"), norm(F.col("__vector")))
    return made.select(*names, F.when(F.col("__vector").isNotNull(), unit).cast("array<float>").alias("embedding"), "failed")


def completed(rows: DataFrame, provider: Provider, prompt: str = "prompt", limits: Limits = Limits()) -> DataFrame:
    """The rows with ``answer``, and ``failed``, the error where there is none. Null and empty prompts aren't asked."""
    names = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            prompts = pdf[prompt].tolist()
            asked = [i for i, p in enumerate(prompts) if p]
            answers, errors = [None] * len(pdf), [None] * len(pdf)
            for i, (answer, error) in zip(asked, called((lambda i=i: provider.complete(prompts[i]) for i in asked), limits), strict=True):
                answers[i], errors[i] = None if answer is None else str(answer), error
            yield pdf[names].assign(answer=answers, failed=errors)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{kinds}, answer string, failed string")


def reranked(candidates: DataFrame, provider: Provider, limits: Limits = Limits()) -> DataFrame:
    """(query_id, chunk_id, rerank) for candidates (query_id, query, chunk_id, content, rank), a query in one call.

    A query's candidates are a bounded list. A failed call gives the query no rows, which keeps its fused order;
    places that don't exist are passed over.
    """
    kind = dict(candidates.dtypes)["query_id"]
    listed = candidates.groupBy("query_id").agg(F.first("query").alias("query"), F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "content"))).alias("c"))
    listed = listed.select("query_id", "query", F.col("c.chunk_id").alias("ids"), F.col("c.content").alias("texts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, out = list(pdf.itertuples()), []
            answers = called((lambda r=r: provider.rerank(r.query, list(r.texts)) for r in rows), limits)
            for r, (answer, _) in zip(rows, answers, strict=True):
                try:
                    out += [(r.query_id, r.ids[a["index"]], float(a["score"])) for a in answer or [] if 0 <= a["index"] < len(r.ids)]
                except Exception:  # noqa: BLE001, S112  an answer that can't be read is a failed call
                    continue
            yield pd.DataFrame(out, columns=["query_id", "chunk_id", "rerank"])

    return listed.mapInPandas(run, f"query_id {kind}, chunk_id long, rerank double")


def cached(asked: DataFrame, cache: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with a ``cache_key``: those that the cache answers, with ``response``, and those still to be asked."""
    live = catalog.latest(cache).where(catalog.alive(now)).select("cache_key", "response")
    return asked.join(live, "cache_key"), asked.join(live, "cache_key", "left_anti")


class LetterProvider:
    """A stand-in without a model: vectors count letters, scores count the query's words."""

    def __init__(self, letters: str = "etaoinsr", fails_on: str | None = None) -> None:
        self.letters, self.fails_on = letters, fails_on

    def embed(self, texts: list[str]) -> list[dict]:
        if self.fails_on and any(self.fails_on in t for t in texts):
            raise TimeoutError("no answer")
        made = [{"index": i, "embedding": [t.lower().count(c) for c in self.letters]} for i, t in enumerate(texts)]
        return made[::-1]

    def rerank(self, query: str, documents: list[str]) -> list[dict]:
        if self.fails_on and self.fails_on in query:
            raise TimeoutError("no answer")
        words = query.lower().split()
        return [{"index": i, "score": sum(d.lower().count(w) for w in words) / (1 + len(d))} for i, d in enumerate(documents)]

    def complete(self, prompt: str) -> str:
        """The two halves of what is asked to expand, as a list in a fence; what is asked to answer, backwards."""
        if self.fails_on and self.fails_on in prompt:
            raise TimeoutError("no answer")
        task, _, text = prompt.partition(": ")
        words = text.split()
        if task != "expand":
            return " ".join(words[::-1])
        half = (len(words) + 1) // 2
        return f"```json\n{json.dumps([' '.join(words[:half]), ' '.join(words[half:])])}\n```"
