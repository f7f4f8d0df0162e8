"""Toxicity: a linear-chain conditional random field that tags toxic words.

Labels are given by document, so words are labelled from them: features of words (the word, its starts)
that occur in many toxic documents and hardly ever in others are selected, and words of toxic documents
that have one are toxic. The field has two states; a word's features and its neighbour's state score it.
Its weights are trained on windows from all over a bounded sample of labelled documents. Every document is scored over
its whole text: forward-backward marginals of its words, then a logistic function of their largest and their
sum. Stretches without a selected feature all have the same potentials, so that a power of one matrix stands
for each; the result is that of the plain recursion.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import saved

STRIPPED = ".,;:!?\"'()[]{}|*#$%&<>-_"


@dataclass(frozen=True)
class Settings:
    #: Bounds on the labelled documents that the field is trained from, by label.
    max_toxic: int = 4000
    max_clean: int = 8000
    #: In how many toxic documents a feature must be, and how surely it must mark them.
    min_documents: int = 4
    min_log_odds: float = 3.0
    #: Words on each side of a marked word in a training window.
    reach: int = 6
    steps: int = 150
    folds: int = 5


@dataclass
class Field:
    """Weights of features for the toxic state; ``trans[a][b]``: from state a to b; ``bias`` of the toxic state."""

    weights: dict[str, float] = field(default_factory=dict)
    trans: list[list[float]] = field(default_factory=lambda: [[0.0, 0.0], [0.0, 0.0]])
    bias: float = -8.0
    #: Logistic weights of: 1, largest marginal, log(1 + sum of marginals).
    scale: list[float] = field(default_factory=lambda: [-2.0, 4.0, 0.0])


def features(word: str) -> list[str]:
    w = word.strip(STRIPPED).lower()
    return [f"={w}", *(w[:n] for n in range(3, 9) if len(w) > n)] if w else []


def _emission(word: str, f: Field) -> float | None:
    """Score of the toxic state; None without a selected feature."""
    found = [f.weights[x] for x in features(word) if x in f.weights]
    return f.bias + sum(found) if found else None


_GAPS = 96


class Scorer:
    """Scores texts with one field. A pass over the words looks each up once; only marked ones enter the recursion."""

    def __init__(self, f: Field, memo: int = 500_000) -> None:
        self.f, self.memo, self.most = f, {}, memo
        (oo, ot), (to, tt) = ([math.exp(x) for x in row] for row in f.trans)
        self.step = np.array([[oo, ot], [to, tt]])
        quiet = self.step * np.array([1.0, math.exp(f.bias)])
        power, self.powers = np.eye(2), []
        for _ in range(_GAPS + 1):  # beyond, a power has rank one to double precision
            self.powers.append(tuple((power / power.max()).ravel().tolist()))
            power = power @ quiet
            power /= power.max()

    def marked(self, text: str) -> tuple[list[int], list[float], int]:
        words, memo = text.split(), self.memo
        if len(memo) > self.most:
            memo.clear()
        at, score = [], []
        for i, w in enumerate(words):
            if w in memo:
                e = memo[w]
            else:
                e = memo[w] = _emission(w, self.f)
            if e is not None:
                at.append(i)
                score.append(e)
        return at, score, len(words)

    def marginals(self, at: list[int], score: list[float], n: int) -> list[float]:
        """Chances that the marked words are toxic, by forward-backward over all n words."""
        oo, ot, to, tt = self.step.ravel().tolist()
        ahead, a0, a1, before = [], 1.0, 0.0, 0  # a text begins in the clean state
        for i, e in zip(at, score, strict=True):
            p, q, r, s = self.powers[min(i - before, _GAPS)]
            a0, a1 = a0 * p + a1 * r, a0 * q + a1 * s
            a0, a1 = a0 * oo + a1 * to, (a0 * ot + a1 * tt) * math.exp(min(e, 500.0))
            t = a0 + a1
            a0, a1 = a0 / t, a1 / t
            ahead.append((a0, a1))
            before = i + 1
        out, b0, b1, after = [0.0] * len(at), 1.0, 1.0, n
        for k in range(len(at) - 1, -1, -1):
            p, q, r, s = self.powers[min(after - at[k] - 1, _GAPS)]
            b0, b1 = p * b0 + q * b1, r * b0 + s * b1
            a0, a1 = ahead[k]
            z = a0 * b0 + a1 * b1
            out[k] = a1 * b1 / z
            e = math.exp(min(score[k], 500.0))
            b0, b1 = oo * b0 + ot * e * b1, to * b0 + tt * e * b1
            t = b0 + b1
            b0, b1, after = b0 / t, b1 / t, at[k]
        return out

    def evidence(self, text: str) -> tuple[float, float, list[tuple[int, float]]]:
        """The largest marginal, their sum, and the likelier toxic words (index, chance)."""
        at, score, n = self.marked(text)
        chance = self.marginals(at, score, n) if at else []
        return max(chance, default=0.0), sum(chance), [(i, p) for i, p in zip(at, chance, strict=True) if p >= 0.5]

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score, and toxic spans (start, end, chance) in code points."""
        top, total, found = self.evidence(text)
        a, b, c = self.f.scale
        value = 1 / (1 + math.exp(-(a + b * top + c * math.log1p(total))))
        spans, wanted = [], dict(found)
        if wanted:
            spans = [(m.start(), m.end(), wanted[i]) for i, m in enumerate(re.finditer(r"\S+", text)) if i in wanted]
            if len(spans) < len(wanted):  # a few controls split words but not \S
                spans, at = [], 0
                for i, w in enumerate(text.split()):
                    at = text.index(w, at)
                    if i in wanted:
                        spans.append((at, at + len(w), wanted[i]))
                    at += len(w)
        return value, spans


def _train_field(windows: list[tuple[list[list[int]], list[int], int]], n_features: int, steps: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Maximum conditional likelihood by Adam; windows: per word its feature indices and its state, and how often it was seen."""
    length = max(len(w) for w, *_ in windows)
    n, often = len(windows), np.array([k for *_, k in windows], float)
    y, real = np.zeros((n, length), int), np.zeros((n, length), bool)
    rows, cols = [], []
    for i, (ws, ys, _) in enumerate(windows):
        y[i, : len(ys)], real[i, : len(ys)] = ys, True
        for t, fs in enumerate(ws):
            rows += [i * length + t] * len(fs)
            cols += fs
    rows, cols = np.array(rows, int), np.array(cols, int)
    theta, m, v = np.zeros(n_features + 5), np.zeros(n_features + 5), np.zeros(n_features + 5)
    theta[n_features + 4] = -3.0
    for step in range(1, steps + 1):
        w, trans, bias = theta[:n_features], theta[n_features : n_features + 4].reshape(2, 2), theta[n_features + 4]
        e = (np.bincount(rows, w[cols], n * length) + bias).reshape(n, length)
        emit = np.stack([np.zeros_like(e), e], -1)
        alpha, beta = np.zeros((n, length, 2)), np.zeros((n, length, 2))
        alpha[:, 0] = trans[0] + emit[:, 0]
        for t in range(1, length):
            new = np.logaddexp(alpha[:, t - 1, :1] + trans[0], alpha[:, t - 1, 1:] + trans[1]) + emit[:, t]
            alpha[:, t] = np.where(real[:, t, None], new, alpha[:, t - 1])
        for t in range(length - 2, -1, -1):
            nxt = emit[:, t + 1] + beta[:, t + 1]
            new = np.logaddexp(trans[:, 0] + nxt[:, :1], trans[:, 1] + nxt[:, 1:])
            beta[:, t] = np.where(real[:, t + 1, None], new, 0.0)
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p = np.exp(alpha + beta - z[:, None, None]) * real[..., None]
        gap = (y - p[..., 1]) * real * often[:, None]
        grad = np.zeros_like(theta)
        grad[:n_features] = np.bincount(cols, gap.ravel()[rows], n_features)
        grad[n_features + 4] = gap.sum()
        for a in (0, 1):
            for b in (0, 1):
                pair = np.exp(alpha[:, :-1, a] + trans[a, b] + (emit + beta)[:, 1:, b] - z[:, None]) * real[:, 1:]
                seen = (y[:, :-1] == a) & (y[:, 1:] == b) & real[:, 1:]
                first = (((y[:, 0] == b) - p[:, 0, b]) * often).sum() if a == 0 else 0.0
                grad[n_features + 2 * a + b] = ((seen - pair) * often[:, None]).sum() + first
        grad = grad / often.sum() - 1e-4 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[:n_features], theta[n_features : n_features + 4].reshape(2, 2), float(theta[n_features + 4])


def _train_scale(x: np.ndarray, y: np.ndarray, often: np.ndarray) -> list[float]:
    """Logistic regression of labels on evidence seen so often, by Newton's method with a small ridge."""
    x1, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        h = (x1 * (often * p * (1 - p))[:, None]).T @ x1 + 0.5 * np.eye(len(w))
        w = w + np.linalg.solve(h, x1.T @ (often * (y - p)) - 0.5 * np.r_[0.0, w[1:]])
    return w.tolist()


def fold(key: str):
    """crc32 of an id's text; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")))


def trained(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Field:
    """The field, from labelled documents outside the held-out fold; the default one if either label is missing.

    Null labels are left out; of repeated labels the larger counts. Only word features, windows of bounded
    length and two numbers a document come to the driver, all of a bounded sample.
    """
    known = (
        labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL")
        .where(F.pmod(fold("doc_id"), F.lit(settings.folds)) != 0)
        .groupBy(F.col("doc_id").alias("id"))
        .agg(F.max("toxic").alias("toxic"))
    )
    first = lambda label, most: known.where(F.col("toxic") == label).orderBy(F.xxhash64("id"), "id").limit(most)
    chosen = saved(first(1, settings.max_toxic).unionByName(first(0, settings.max_clean)))
    sample = saved(
        docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("id", "toxic", F.coalesce("text", F.lit("")).alias("text"))
    )

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(x, t) for text, t in zip(pdf["text"], pdf["toxic"], strict=True) for x in {x for w in set(text.split()) for x in features(w)}]
            yield pd.DataFrame(out, columns=["feature", "toxic"]).astype({"toxic": "int32"})

    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals.get(1) or not totals.get(0):
        return Field()
    counts = (
        sample.mapInPandas(listed, "feature string, toxic int")
        .groupBy("feature")
        .agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
        .where(F.col("t") >= settings.min_documents)
        .withColumn("odds", F.log((F.col("t") + 0.5) / (totals[1] + 1.0)) - F.log((F.col("c") + 0.5) / (totals[0] + 1.0)))
        .where(F.col("odds") >= settings.min_log_odds)
        .orderBy(F.desc(F.col("odds") * F.sqrt("t")), "feature")
    )
    index = {r["feature"]: i for i, r in enumerate(counts.collect())}
    if not index:
        return Field()
    reach = settings.reach

    def windowed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
                found = [[index[x] for x in features(w) if x in index] for w in text.split()]
                marked = [i for i, fs in enumerate(found) if fs]
                starts, end = [], -1
                for i in [*marked, *([] if marked else range(0, len(found), max(1, len(found) // 3)))]:
                    if i >= end:
                        starts.append(max(0, i - reach))
                        end = i + reach
                for s in starts:
                    w = found[s : s + 2 * reach + 1]
                    out.append(([x for fs in w for x in [*fs, -1]], [int(bool(toxic) and bool(fs)) for fs in w]))
            yield pd.DataFrame(out, columns=["features", "states"])

    seen = sample.mapInPandas(windowed, "features array<int>, states array<int>").groupBy("features", "states").agg(F.count(F.lit(1)).alias("often"))
    rows = sorted(seen.collect(), key=lambda r: (r["features"], r["states"]))  # most windows have no feature, and are one
    windows = []
    for r in rows:
        ws, w = [], []
        for x in r["features"]:
            if x < 0:
                ws.append(w)
                w = []
            else:
                w.append(x)
        windows.append((ws, list(r["states"]), r["often"]))
    if not windows:
        return Field()
    weights, trans, bias = _train_field(windows, len(index), settings.steps)
    learnt = Field({x: float(weights[i]) for x, i in index.items()}, trans.tolist(), bias)

    def weighed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(learnt)
        for pdf in batches:
            got = [scorer.evidence(text)[:2] for text in pdf["text"]]
            yield pd.DataFrame({"top": [g[0] for g in got], "total": [g[1] for g in got], "toxic": pdf["toxic"].to_numpy()})

    points = sample.mapInPandas(weighed, "top double, total double, toxic int").groupBy("top", "total", "toxic").agg(F.count(F.lit(1)).alias("often"))
    e = points.toPandas().sort_values(["top", "total", "toxic"])  # no more than documents in the sample; most have no mark, and are one
    learnt.scale = _train_scale(np.column_stack([e["top"], np.log1p(e["total"])]), e["toxic"].to_numpy(float), e["often"].to_numpy(float))
    return learnt


def scored(docs: DataFrame, model: Field, folds: int = 5) -> DataFrame:
    """Every document's score, verdict and toxic spans (start, end, chance; code points, end exclusive).

    Null text counts as empty and gets the score of a text without marked words. Rows with equal ids are
    scored each by its own text. Extra columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for pdf in batches:
            got = [scorer.score(text or "") for text in pdf["text"]]
            pdf["score"] = [g[0] for g in got]
            pdf["spans"] = [[{"start": a, "end": b, "chance": p} for a, b, p in g[1]] for g in got]
            yield pdf[["doc_id", "held_out", "score", "spans"]]

    rows = docs.select("doc_id", (F.pmod(fold("doc_id"), F.lit(folds)) == 0).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    out = rows.mapInPandas(run, f"doc_id {kind}, held_out boolean, score double, spans array<struct<start:int,end:int,chance:double>>")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
