"""Text analysis as column expressions."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F



def _plain(c: str) -> tuple[str, str] | None:
    """The ASCII letter and the one mark that a character is made of."""
    d = unicodedata.normalize("NFD", c)
    return (d[0], d[1]) if len(d) == 2 and d[0].isascii() and d[0].isalpha() and unicodedata.category(d[1]) == "Mn" else None


def folded(c: str) -> str:
    """A letter as tokens have it: by simple case folding, and without its mark if it is an ASCII letter with a single one."""
    small = next((f for f in (c.casefold(), c.lower()) if len(f) == 1), c)
    made = _plain(c) or _plain(small)
    return made[0].lower() if made else small


def _folding() -> tuple[str, str]:
    """What is folded and to what, by Unicode's own tables; the marks of such letters, at the end, fold to nothing."""
    letters = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c)[0] == "L" and folded(c) != c]
    marks = sorted({made[1] for made in map(_plain, letters) if made})
    return "".join(letters + marks), "".join(map(folded, letters))


FOLDED, TO = _folding()
NOT_TOKEN = r"[^\p{L}\p{N}\p{Co}]+"
HAN = r"[㐀-鿿]"
TITLE_LINE = r"(?m)^#{1,4}[ \t]+(.+)$"


def tokens(text: Column) -> Column:
    """Tokens in lower case and without simple diacritics, whether these are parts of letters or follow them, in order; none for null or blank text."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), FOLDED, TO), NOT_TOKEN), "")


def has_han(text: Column) -> Column:
    return text.rlike(HAN)


def phrases_of(query: Column, segments: Column | None = None) -> Column:
    """A query as an OR of phrases (array of token arrays).

    Text without Han characters is one phrase. With segments of Han text (``segments``, from any
    segmenter), each distinct one is a phrase besides the whole. Phrases without tokens match nothing.
    """
    whole = F.array(tokens(query))
    if segments is not None:
        more = F.array_distinct(F.transform(segments, tokens))
        whole = F.when(has_han(query) & (F.size(segments) > 1), F.array_distinct(F.concat(whole, more))).otherwise(whole)
    return F.filter(whole, lambda p: F.size(p) > 0)


def expanded_for_index(text: Column, segments: Column) -> Column:
    """Text to index: Han text with its distinct segments appended, other text as it is."""
    own = F.array_distinct(F.filter(segments, lambda s: (F.trim(s) != "") & (s != text)))
    return F.when(has_han(text) & (F.size(own) > 0), F.concat_ws(" ", text, F.array_join(own, " "))).otherwise(text)


def distinct_queries(original: Column, expansions: Column) -> Column:
    """The original first, then what expansion adds, each once."""
    return F.array_distinct(F.concat(F.array(original), F.coalesce(expansions, F.array().cast("array<string>"))))


def title_of(content: Column, path: Column) -> Column:
    """The first heading of level 1 to 4, else the file's name without its ending."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", "")
    found = F.trim(F.regexp_extract(F.coalesce(content, F.lit("")), TITLE_LINE, 1))
    return F.when(found != "", found).otherwise(stem)


def snippet(content: Column, query: Column, most: int = 180) -> Column:
    """A window around the first query word that occurs, newlines as spaces, with ellipses where cut."""
    low = F.lower(content)
    wanted = F.filter(F.split(F.lower(query), r"\s+"), lambda w: F.length(w) > 1)
    places = F.filter(F.transform(wanted, lambda w: F.instr(low, w)), lambda p: p > 0)
    at = F.coalesce(F.get(places, 0) - 1, F.lit(0))
    start = F.greatest(F.lit(0), at - most // 3)
    cut = F.trim(F.regexp_replace(F.substring(content, start + 1, F.lit(most)), r"\n", " "))
    return F.concat(F.when(start > 0, F.lit("…")).otherwise(""), cut, F.when(start + most < F.length(content), F.lit("…")).otherwise(""))


def compact(text: Column, most: int = 280) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, most)
