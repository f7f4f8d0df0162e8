"""Reading what language models and rerankers answer. Nothing here fails: what can't be read is null."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions.text import FOLDED, TO

#: Names under which models wrap their lists, in the order in which they are tried.
LIST_KEYS = ("alternatives", "queries", "rewrites", "expanded_queries", "suggestions", "results", "items")


def _strings(values: Column) -> Column:
    """The trimmed strings of an array of variants; null if none is left."""
    kept = F.transform(F.filter(values, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.trim(F.variant_get(v, "$", "string")))
    kept = F.filter(kept, lambda s: s != "")
    return F.when(F.size(kept) > 0, kept)


def expansions(raw: Column) -> Column:
    """The query alternatives in an answer: an array, an object holding one, or the first array in prose."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(raw), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""))
    value = F.try_parse_json(bare)
    listed = lambda v: _strings(F.try_variant_get(v, "$", "array<variant>"))
    known = [_strings(F.try_variant_get(value, f"$.{k}", "array<variant>")) for k in LIST_KEYS]
    fields = F.map_values(F.try_variant_get(value, "$", "map<string,variant>"))
    any_field = F.get(F.filter(F.transform(fields, listed), lambda a: a.isNotNull()), F.lit(0))
    prose = listed(F.try_parse_json(F.regexp_extract(bare, r"\[[\s\S]*?\]", 0)))
    return F.coalesce(listed(value), *known, any_field, prose)


def reranked(results: Column, documents: Column) -> Column:
    """array<struct<index, score>> by falling score from results (index, relevance_score, score, document).

    A result without an index is found by its text. Null if there are results and none can be placed.
    """
    at = lambda r: F.coalesce(r["index"].cast("int"), (F.array_position(documents, r["document"]) - 1).cast("int"))
    placed = F.transform(
        results,
        lambda r: F.struct((-F.coalesce(r["relevance_score"], r["score"], F.lit(0.0))).alias("neg"), at(r).alias("index")),
    )
    fit = F.filter(placed, lambda p: (p["index"] >= 0) & (p["index"] < F.size(documents)))
    ranked = F.transform(F.array_sort(fit), lambda p: F.struct(p["index"].alias("index"), (-p["neg"]).alias("score")))
    return F.when((F.size(ranked) > 0) | (F.size(results) == 0), ranked)


#: Tokens and their folding, as the index has them.
_FOLD = str.maketrans(FOLDED[: len(TO)], TO, FOLDED[len(TO) :])
_TOKEN = regex.compile(rf"[\p{{L}}\p{{N}}\p{{Co}}][\p{{L}}\p{{N}}\p{{Co}}{FOLDED[len(TO):]}]*")


#: What a phrase counts in a window at its first and at its other places, and a window at the start of a text or a sentence.
NEW, AGAIN, TEXT_START, SENTENCE_START = 1000, 1, 120, 100
#: What lies between a token and the end of the sentence before it.
_SENTENCE_END = regex.compile(r"[.:][ \t\n\r]+$")


def _matches(low: list[str], phrases) -> list[tuple[int, int, int]]:
    """Where phrases lie among tokens: (first token, token after the last, number of the phrase), in order."""
    by_first: dict[str, list[tuple[int, list[str]]]] = {}
    for k, phrase in enumerate(phrases):
        if len(phrase):
            by_first.setdefault(phrase[0], []).append((k, list(phrase)))
    return [(i, i + len(p), k) for i, t in enumerate(low) for k, p in by_first.get(t, ()) if low[i : i + len(p)] == p]


def _window(spans: list[tuple[int, int, int]], sentences: list[int], n: int, most: int) -> int:
    """The first token of the best window of ``most`` tokens among ``n``.

    Windows begin at a match, and are then moved so that their matches lie in the middle, or at the start of its
    sentence, which counts a little. Phrases that are new to a window count most. The first of equal ones is taken.
    """
    firsts = [a for a, _, _ in spans]
    best, at = -1, 0

    def held(start: int) -> tuple[int, list[tuple[int, int, int]]]:
        inside = spans[bisect_left(firsts, start) : bisect_left(firsts, start + most)]
        kinds = len({k for _, _, k in inside})
        return kinds * NEW + (len(inside) - kinds) * AGAIN, inside

    for first in firsts:
        weight, inside = held(first)
        if weight > best:
            spare = most - (inside[-1][1] - first)
            # half of what is spare goes before the matches; halves are cut towards zero
            best, at = weight, max(0, min(first - int(spare / 2), n - most))
        begun = bisect_right(sentences, first) - 1
        if n > most and begun >= 0 and sentences[begun] < first:
            start = sentences[begun]
            weight = held(start)[0] + (SENTENCE_START if start else TEXT_START)
            if weight > best:
                best, at = weight, start
    return at


def highlight(content: str | None, phrases, most: int = 20) -> str | None:
    """The best window of so many tokens, as SQLite's full-text engine chooses it, with what matches between ``**``.

    Null if none of the phrases (arrays of folded tokens) occurs, or for a null text. Matches that overlap are marked as
    one; those that begin before the window aren't marked, and those that go on after it are marked up to its end.
    """
    if not content:
        return None
    found = [(m.start(), m.end(), m.group().translate(_FOLD)) for m in _TOKEN.finditer(content)]
    spans = _matches([t for _, _, t in found], [] if phrases is None else phrases)
    if not spans:
        return None
    ends = [0] + [e for _, e, _ in found]
    sentences = [i for i, (a, _, _) in enumerate(found) if i == 0 or _SENTENCE_END.search(content, ends[i], a, partial=False)]
    start = _window(spans, sentences, len(found), most)
    end = min(len(found), start + most)
    joined: list[list[int]] = []
    for a, b, _ in spans:
        if joined and a < joined[-1][1]:
            joined[-1][1] = max(b, joined[-1][1])
        else:
            joined.append([a, b])
    marked = [(a, min(b, end)) for a, b in joined if start <= a < end]
    opened, closed = {a for a, _ in marked}, {b - 1 for _, b in marked}
    parts, at = ["…" if start else ""], found[start][0] if start else 0
    for i in range(start, end):
        a, b, _ = found[i]
        parts += [content[at:a], "**" * (i in opened), content[a:b], "**" * (i in closed)]
        at = b
    return "".join(parts) + ("…" if end < len(found) else content[at:])


@F.pandas_udf(StringType())
def highlighted(content: pd.Series, phrases: pd.Series) -> pd.Series:
    """For final rows only: see ``highlight``."""
    return pd.Series([highlight(c, p) for c, p in zip(content, phrases, strict=True)], dtype=object)


def with_marks(rows: DataFrame) -> DataFrame:
    """Final rows without content and phrases; their snippet marks what matches, where something does."""
    schema = rows.drop("content", "phrases").schema
    names = schema.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [highlight(c, p) for c, p in zip(pdf["content"], pdf["phrases"], strict=True)]
            pdf["snippet"] = [s if f is None else f for f, s in zip(found, pdf["snippet"], strict=True)]
            yield pdf[names]

    return rows.mapInPandas(run, schema)
