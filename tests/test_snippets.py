"""Marked snippets against SQLite's own, on random texts."""

import random
import sqlite3

from tessera.functions.responses import _FOLD, _TOKEN, highlight

WORDS = "red fox Été ran far b c d e f g a1 naïve cafés Über 9".split()
BETWEEN = (" ", " ", " ", ", ", ". ", ".\n", ": ", ".", "  ", "\n\n", " - ", ". \t", "; ")


def drawn(rng: random.Random) -> str:
    most = rng.choice((3, 15, 25, 60, 300))
    return "".join(rng.choice(WORDS[: rng.choice((5, 12, len(WORDS)))]) + rng.choice(BETWEEN) for _ in range(rng.randint(1, most)))


def folded(text: str) -> list[str]:
    return [m.group().translate(_FOLD) for m in _TOKEN.finditer(text)]


def test_snippets_are_those_of_sqlite():
    """3,000 random texts, each with one to four phrases of 1 to 30 tokens; all agree."""
    rng, con = random.Random(7), sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(content, tokenize = 'unicode61 remove_diacritics 1')")
    compared = 0
    for i in range(3000):
        text = rng.choice(("", "  ", "(")) + drawn(rng)
        own = folded(text)
        phrases = []
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(own))
            phrases.append(own[at : at + rng.choice((1, 1, 1, 2, 3, 5, 30))])
        con.execute("INSERT INTO t(rowid, content) VALUES (?, ?)", (i, text))
        asked = " OR ".join('"' + " ".join(p) + '"' for p in phrases)
        want = con.execute("SELECT snippet(t, 0, '**', '**', '…', 20) FROM t WHERE rowid = ? AND t MATCH ?", (i, asked)).fetchone()[0]
        assert highlight(text, phrases) == want, (text, phrases)
        compared += 1
    assert compared == 3000


def test_nothing_to_mark():
    assert highlight("a b", []) is None and highlight("a b", None) is None and highlight("", [["a"]]) is None
    assert highlight("a b", [[]]) is None and highlight("?!", [["a"]]) is None


def test_long_texts_take_one_pass():
    text = "red fox. " * 100_000
    assert highlight(text, [["red"], ["fox"], ["red", "fox"]]).count("**") >= 20
