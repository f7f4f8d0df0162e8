"""The field against enumeration, and on data that its generator didn't make."""

import random
import re

import numpy as np
import pandas as pd

from tessera.llm import pii

DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"


def test_decoding_equals_enumeration():
    """The best of all segmentations, by brute force over sets of candidates that don't overlap."""
    r, g = random.Random(6), np.random.default_rng(6)
    pieces = ["a.b@c.org", "17", "555", "(017)", "x", "at", "dot", "net", "4111", "1111", "+1", "token", "=", "a9f0c3d2b1e8", "10.0.0.1"]
    for _ in range(60):
        weights = g.normal(0, 1, (len(pii.KINDS), len(pii.NAMES)))
        words = [pii._trimmed(m) for m in pii._WORD.finditer(" ".join(r.choice(pieces) for _ in range(r.randint(1, 7))))]
        found = [(i, j, k, float(weights[k] @ np.array(f))) for i, j, k, f in pii.candidates(words)]

        def best(at, found=found, n=len(words)):
            if at == n:
                return 0.0
            return max(best(at + 1), *(s + best(j + 1) for i, j, _, s in found if i == at), -np.inf)

        score = {(i, j, k): s for i, j, k, s in found}
        got = pii.decoded(words, weights)
        assert all(a[1] < b[0] for a, b in zip(got, got[1:], strict=False))
        assert abs(sum(score[x] for x in got) - best(0)) < 1e-9


def test_planted_data_is_found_and_clean_text_left_alone():
    """Documents of the fixture: keys after a word for them, a second card number in a run, and nothing else."""
    weights, planted, caught, other = pii.trained(), 0, 0, 0
    for text in pd.read_parquet(DOCUMENTS)["text"].dropna():
        base, every = pii.all_spans(text, weights)
        secrets = {m.span(1) for m in re.finditer(r'token = "([0-9a-f]{40})"', text)}
        cards = {m.span(1) for m in re.finditer(r"(?<![0-9])([0-9]{16})(?= |$)", text) if pii.luhn(m[1])}
        found = {(s, e) for _, s, e in every}
        planted, caught = planted + len(secrets | cards), caught + len((secrets | cards) & found)
        other += sum((s, e) not in secrets | cards for _, s, e in set(every) - set(base))
    assert planted >= 20 and caught == planted and other <= 0.02 * planted


def test_secrets_of_other_shapes():
    weights = pii.trained()
    kinds = lambda t: [pii.KINDS[k] for k, _, _ in pii.all_spans(t, weights)[1]]
    assert kinds("set api_key=Zk3vQ9mL2xT7bN4pR8wY1cD6 and go on") == ["secret"]
    assert kinds("his password: hunter22-Qx71 was weak") == ["secret"]
    assert kinds("commit 3f2a9c0d1e4b5a6978c0d1e2f3a4b5c6d7e8f901 went in") == []
    assert pii.masked("x token = \"3f2a9c0d1e4b5a6978c0d1e2f3a4b5c6\" y", pii.all_spans("x token = \"3f2a9c0d1e4b5a6978c0d1e2f3a4b5c6\" y", weights)[1]) == 'x token = "<SECRET>" y'


def test_long_secrets_are_found_whole():
    weights = pii.trained()
    for n in (10, 50, 60, 500):
        key = "a1b2c3d4e5" * n
        assert (pii.KINDS.index("secret"), 9, 9 + len(key)) in pii.all_spans(f'token = "{key}" end', weights)[1]
