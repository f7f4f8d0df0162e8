"""Segments of Han text, in which words are not set apart.

A segmenter is a function from a text column to an array of its segments in order. ``bigrams`` needs no word
list and stays in the JVM; ``dictionary`` takes the longest word of a list at each place, and pairs of
characters where none fits. Other scripts are cut at white space.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Segmenter = Callable[[Column], Column]

#: Runs of Han characters, and of others without white space.
_RUN = "[㐀-鿿]+|[^\\s㐀-鿿]+"
_FIRST, _LAST = "㐀", "鿿"


def bigrams(text: Column) -> Column:
    """Neighbouring pairs of each Han run (a lone character as it is), and the words between."""

    def of(run: Column) -> Column:
        # characters by place: a substring of a long run would be found by walking to it
        chars = F.split(run, "")
        after = F.slice(chars, F.lit(2), F.greatest(F.size(chars) - 1, F.lit(0)))
        pairs = F.array_compact(F.zip_with(chars, after, lambda a, b: F.concat(a, b)))
        return F.when(run.rlike("^[㐀-鿿]{2}"), pairs).otherwise(F.array(run))

    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(_RUN), F.lit(0)), of))


def segments(text: str, words: frozenset[str], longest: int) -> list[str]:
    """Longest words first; stretches without one in overlapping pairs."""
    out: list[str] = []

    def pairs(s: str) -> list[str]:
        return [s] if len(s) == 1 else [s[i : i + 2] for i in range(len(s) - 1)]

    for run in re.findall(_RUN, text):
        if not _FIRST <= run[0] <= _LAST:
            out.append(run)
            continue
        at = since = 0
        while at < len(run):
            n = next((n for n in range(min(longest, len(run) - at), 0, -1) if run[at : at + n] in words), 0)
            if n:
                out += [*(pairs(run[since:at]) if since < at else []), run[at : at + n]]
                since = at + n
            at += n or 1
        if since < at:
            out += pairs(run[since:at])
    return out


def dictionary(words: Iterable[str]) -> Segmenter:
    """A segmenter by a word list, which is shipped with the function; texts without Han characters never reach Python."""
    known = frozenset(w for w in words if w)
    longest = max(map(len, known), default=1)

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else segments(t, known, longest))

    return lambda text: run(F.when(text.rlike("[㐀-鿿]"), text))
