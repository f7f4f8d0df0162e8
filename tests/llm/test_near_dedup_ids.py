"""Ids that several unlike texts share, in large families, on both sides of the settings that divide the work."""

import random

import pytest

from tessera.llm import near_dedup
from tessera.llm.near_dedup import Settings


def plain_components(rows, k, percent=80):
    sets = []
    for _, text in rows:
        w = text.lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    top = {i: i for i, _ in rows}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(rows[a][0]), root(rows[b][0])))
                top[y] = x
    return {i: root(i) for i, _ in rows}


def family(seed):
    """Texts around a few origins, changed a little; some ids have two or three texts, of unlike sizes and families."""
    r = random.Random(seed)
    words, at = [f"w{seed}x{i}" for i in range(3000)], seed * 10_000
    origins = [[r.choice(words) for _ in range(n)] for n in (120, 120, 180, 60)]
    rows = []
    for i in range(70):
        o = list(r.choice(origins))
        for _ in range(r.choice((0, 1, 3, 6, 9))):
            o[r.randrange(len(o))] = r.choice(words)
        rows.append((at + (r.randrange(60) if i % 4 == 0 else 1000 + i), " ".join(o[: len(o) - r.choice((0, 0, 5, 20))])))
    return rows + [(rows[k][0], " ".join(r.choice(words) for _ in range(r.choice((20, 200))))) for k in range(0, 40, 3)] + rows[:5]


@pytest.mark.parametrize("sizes", [{"most_in_task": 8, "most_sharing": 4}, {"most_in_task": 1000}])
def test_every_text_of_an_id_is_linked(spark, sizes):
    families = [family(seed) for seed in range(10)]
    rows = [r for f in families for r in f]
    want = {i: t for f in families for i, t in plain_components(f, 2).items()}
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Settings(shingle=2, band=2, times=12, **sizes)).collect()
    assert {(r["doc_id"], r["component_id"]) for r in found} == set(want.items()) and len(found) == len(rows)
    assert all(r["kept"] == (r["doc_id"] == want[r["doc_id"]]) for r in found)


def test_ids_at_the_ends_of_longs(spark):
    rows = [((1 << 63) - 1, "a b c d e"), ((1 << 63) - 1, "p q r s t"), (5, "p q r s t"), (-3, "a b c d e f")]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Settings(shingle=2, band=1)).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {i: t for i, t in plain_components(rows, 2).items()}
