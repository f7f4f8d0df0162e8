"""The URL filter on addresses whose words were all left out of training."""

import math
import random
import re

import pytest
import xxhash

from tessera.llm import url_filter as u

EACH = 6


def chance(weights, url):
    """The regression's chance, computed anew."""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    grams = [c[i : i + n] for c in (f"^{host}$", f"<{path}>") for n in u.SIZES for i in range(len(c) - n + 1)]
    buckets = [(lambda h: h - (1 << 64) * (h >> 63))(xxhash.xxh64_intdigest(g.encode(), 42)) % u.BUCKETS for g in grams]
    return 1 / (1 + math.exp(-(weights[-1] + sum(weights[b] for b in buckets) / math.sqrt(max(1, len(grams))))))


@pytest.mark.parametrize("half", [0, 1])
def test_words_left_out(spark, half):
    """Every other word of each list trains, the others are judged: at least 0.6 of what is to block, at most 0.05 of the rest.

    Words of one stem are neighbours in the lists, so that many a word left out has kin in training; whole
    families left out are found far less often (README).
    """
    rows = u.labelled_urls(EACH)
    assert len({w for w in u.UNWANTED} & {w for w in u.WANTED}) == 0
    sizes = (len(u.UNWANTED), len(u.WANTED), 3 * len(u.UNWANTED))
    word = [i for n in sizes for i in range(n) for _ in range(EACH)]
    assert len(word) == len(rows)
    seen = [r for r, i in zip(rows, word, strict=True) if i % 2 == half]
    new = [r for r, i in zip(rows, word, strict=True) if i % 2 != half]
    weights = u.trained(u.parts_of(spark.createDataFrame(seen, "url string, label int")))
    found = [chance(weights, url) > 0.5 for url, label in new if label]
    wrong = [chance(weights, url) > 0.5 for url, label in new if not label]
    assert sum(found) >= 0.6 * len(found) and sum(wrong) <= 0.05 * len(wrong)
    # names of other syllables, which no list has
    rng = random.Random(5)
    names = ["".join(rng.choice(u.ONSETS) + rng.choice(u.VOWELS) + rng.choice(u.CODAS) for _ in range(rng.randint(1, 3))) for _ in range(500)]
    assert sum(chance(weights, f"http://{n}.example.com/en/{i}") > 0.5 for i, n in enumerate(names)) <= 0.05 * len(names)
