"""Operators against plain versions, round trips and held-out labels."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessera.llm import fingerprints, html_text, mixing, near_dedup, packing, pii, quality_classifier, quality_rules, queries, toxicity, url_filter

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts():
    d = pd.read_parquet(f"{SF}/documents.parquet")
    return dict(zip(d["doc_id"], d["text"], strict=True))


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def shingles(text, k):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in re.findall(r"[^\x20\x09-\x0D]+", text)]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def test_edited_texts_and_likeness(spark, docs, texts):
    rows = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).collect()}
    ids, errors = sorted(texts), []
    cut = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        a, b, half = texts[i], texts[j], len(texts[i]) // 2
        edited = a[: len(a) - half] + b[:half]
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and rows[i]["n_chars"] == len(a)
        A, E = cut(a), cut(edited)
        errors.append(abs(rows[i]["near_edited"] - len(A & E) / len(A | E)))
    assert np.mean(errors) < 0.08
    by_text = {}
    for i in ids:
        assert by_text.setdefault(texts[i], rows[i]["fingerprint"]) == rows[i]["fingerprint"]


def test_sketches_merge(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a b c d e f g h i j", "p q r s t u v w x y z")], "t string, u string")
    df = fingerprints.with_sketch(fingerprints.with_sketch(df, "t", "a"), "u", "b")
    r = df.select("a", "b", fingerprints.merged(F.col("a"), F.col("b")).alias("m"), fingerprints.containment(F.col("a"), F.col("b")).alias("c")).first()
    low = [h for h in r["a"] + r["b"] if h <= fingerprints._limit(fingerprints.FRACTION)]
    assert r["m"] == (sorted(set(low)) or [min(r["a"] + r["b"])]) and 0 <= r["c"] <= 1


def test_html_layout():
    page = """<html><head><title>T</title><script>if (a<b) x("<p>no</p>")</script></head><body><h1>Head &amp; line</h1>
    <p>One <b>two</b>  three<p>next<br>line<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul><div style="display: none">hid<p>den</div>
    <table><tr><th>Name<th>Qty<tr><td>apple pie<td>3<tr><td>kiwi<td>12</table><pre>  keep
   this</pre><span hidden>no</span>tail <!-- c -->end"""
    assert html_text.rendered(page)[0] == (
        "Head & line\n\nOne two three\n\nnext\nline\n\n- a\n- b\n  3. x\n  4. y\n- c\n\nName       Qty\napple pie  3\nkiwi       12\n\n  keep\n   this\n\ntail end"
    )


def test_html_keeps_all_words_of_plain_markup():
    r = random.Random(3)
    for _ in range(50):
        words = [f"w{r.randint(0, 999)}" for _ in range(r.randint(1, 60))]
        source = "".join(f"<{(t := r.choice(['p', 'div', 'li', 'b', 'td', 'h2', 'span']))}>{w} " + (f"</{t}>" if r.random() < 0.6 else "") for w in words)
        assert html_text.rendered(source)[0].replace("- ", " ").split() == words


def test_packing_round_trip(spark, docs, texts):
    from tokenizers import Tokenizer

    public_tokenizers = pytest.importorskip("public_tokenizers")
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    cfg = packing.Settings(rows_per_block=64)
    rows = sorted((r.asDict() for r in packing.packed(docs, cfg).collect()), key=lambda r: (r["doc_id"], r["start"]))
    built = {}
    for r in rows:
        assert len(built.setdefault(r["doc_id"], [])) == r["start"] and len(r["ids"]) == r["length"]
        built[r["doc_id"]] += r["ids"]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    for i, text in texts.items():
        assert built[i] == t.encode(text, add_special_tokens=False).ids + [1]
    filled = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert filled.get(r["sequence_id"], 0) == r["offset"]
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 2048
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in filled.values())
    assert padding < 0.02 * sum(filled.values())


def test_cuts_are_the_cheapest():
    r = random.Random(5)
    cfg = packing.Settings(size=16, least_power=4)
    for _ in range(200):
        n = r.randint(1, 60)
        at = sorted({0, n, *range(0, n, 16), *(r.randint(0, n) for _ in range(20))})
        cost = [0.0, *(float(r.choice((0, 2, 8))) for _ in at[1:])]
        last = r.random() < 0.5
        free = {1 << k for k in range(5) if (1 << k) >= (1 if last else 4)}
        price = lambda m: 0 if m in free else cfg.size - m  # noqa: E731, B023
        best = [0.0] + [float("inf")] * (len(at) - 1)
        for j in range(1, len(at)):
            best[j] = min(best[i] + price(at[j] - at[i]) + cost[j] + cfg.window_cost for i in range(j) if at[j] - at[i] <= cfg.size)  # noqa: B023
        cuts, total, before = packing.best_cuts(at, cost, last, cfg), 0.0, 0
        for c in cuts:
            total += price(c - before) + cost[at.index(c)] + cfg.window_cost
            before = c
        assert abs(total - best[-1]) < 1e-9


def test_mixture_equals_sql(spark, docs):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{SF}/documents.parquet'")
    want = con.sql(mixing.MIXTURE_SQL).df().sort_values("doc_id").reset_index(drop=True)
    got = mixing.mixture(docs).select(list(want.columns)).toPandas().sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want, check_dtype=False)
    copies = Counter(r["doc_id"] for r in mixing.mixed_documents(docs).select("doc_id").collect())
    assert all(copies.get(r.doc_id, 0) * r.size == r.taken for r in got[["doc_id", "size", "taken"]].itertuples(index=False))


def test_base_spans_equal_the_plain_patterns():
    patterns = (
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
    )

    def plain(text):
        for kind, p in enumerate(patterns):
            for m in re.finditer(p, text):
                d = re.sub("[^0-9]", "", m.group())
                if kind == 1 and any(int(x) > 255 for x in m.group().split(".")) or kind == 2 and not (16 <= len(d) <= 19 and pii.luhn(d)) or kind == 3 and not 8 <= len(d) <= 15:
                    continue
                yield kind, *m.span()

    r = random.Random(3)
    pieces = ["1", "2", "55", ".", "@", "a", "b-", "+", " ", "(", ")", "-", "é", "4111111111111111", "\n"]
    for _ in range(5000):
        t = "".join(r.choice(pieces) for _ in range(r.randint(0, 25)))
        assert list(plain(t)) == pii.base_spans(t), t


def test_field_finds_made_up_data_and_spares_the_rest():
    weights, right, wrong, missed = pii.trained(), 0, 0, 0
    for text, parts in pii.sentences(200, seed=77):
        words, want, at = [pii._trimmed(m) for m in pii._WORD.finditer(text)], set(), 0
        for phrase, kind in parts:
            n = len(pii._WORD.findall(phrase))
            want |= {(at, at + n - 1, kind)} if kind >= 0 else set()
            at += n
        got = set(pii.decoded(words, weights))
        right, wrong, missed = right + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert wrong + missed < 0.05 * right
    assert pii.digest(pii.all_spans("pay 4111111111111111 4012888888881881 now", weights)[1]) == "card:4:20,card:21:37"
    assert pii.masked("mail a.b@c.example.com or +1 (017) 555-7713.", pii.all_spans("mail a.b@c.example.com or +1 (017) 555-7713.", weights)[1]) == "mail <EMAIL> or <PHONE>."


def test_components_equal_all_pairs(spark, docs, texts):
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs, near_dedup.Settings(shingle=2)).collect()}
    check_components(got, texts, 2)


def check_components(got, texts, k):
    sets, top = {i: shingles(t, k) for i, t in texts.items()}, {i: i for i in texts}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            x, y = sets[i], sets[j]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = root(i), root(j)
                top[max(p, q)] = min(p, q)
    for i in ids:
        assert got[i]["n_shingles"] == len(sets[i]) and got[i]["component_id"] == root(i) and got[i]["kept"] == (root(i) == i), i


def test_large_families_equal_all_pairs(spark):
    """A family larger than a task's bound, with chains that only lead through copies of copies."""
    r = random.Random(9)
    base = [f"w{r.randint(0, 10_000)}" for _ in range(90)]
    rows, last = [], list(base)
    for i in range(160):
        words = list(base)
        for _ in range(r.randint(0, 9)):
            words[r.randrange(len(words))] = f"v{r.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    for i in range(160, 175):  # a chain that drifts away
        for _ in range(3):
            last[r.randrange(len(last))] = f"u{r.randint(0, 10**6)}"
        rows.append((i, " ".join(last)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for cfg in (near_dedup.Settings(shingle=2, most_in_task=24, most_sharing=4), near_dedup.Settings(shingle=2, most_in_task=1000)):
        check_components({r["doc_id"]: r for r in near_dedup.near_duplicates(docs, cfg).collect()}, dict(rows), 2)


def test_stragglers_meet_by_their_distance_from_the_pivot(spark):
    """Rewritten copies at all distances from a family's middle, some linked to each other only, and an id with two texts."""
    r = random.Random(4)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(60):
        words = list(base)
        for j in r.sample(range(120), r.randint(0, 3)):
            words[j] = f"v{r.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    for i in range(60, 110, 2):  # pairs of twins, ever farther off
        words = list(base)
        for j in r.sample(range(120), (i - 56) // 3):
            words[j] = f"u{r.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
        words[r.randrange(120)] = "twin"
        rows.append((i + 1, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cfg = near_dedup.Settings(shingle=2, most_in_task=8, most_sharing=4)
    check_components({x["doc_id"]: x for x in near_dedup.near_duplicates(docs, cfg).collect()}, dict(rows), 2)
    twice = docs.unionByName(spark.createDataFrame([(5, "quite another text of one more document")], docs.schema))
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(twice, cfg).collect()}
    assert got == {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(docs, cfg).collect()}


def test_registers_merge_and_estimate():
    cfg, r = near_dedup.Settings(), np.random.default_rng(4)
    for j in (0.3, 0.6, 0.8, 0.95):
        both = r.integers(0, 2**63, int(1000 * j), np.uint64)
        a, b = (np.unique(np.r_[both, r.integers(0, 2**63, (1000 - len(both)) // 2, np.uint64)]) for _ in range(2))
        u, v = near_dedup.registers(a, cfg), near_dedup.registers(b, cfg)
        assert (near_dedup.registers(np.union1d(a, b), cfg) == np.maximum(u, v)).all()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        got = near_dedup.estimate(u[None], v[None], np.array([float(len(a))]), np.array([float(len(b))]), cfg)[0]
        assert abs(got - true) < 0.12


def test_quality_counts_equal_plain(spark, docs, texts, labelled):
    for r in quality_rules.judged(docs, labelled).collect():
        text = texts[r["doc_id"]]
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n, covered = Counter(windows), set()
        for i, x in enumerate(windows):
            if n[x] > 1:
                covered.update(range(i, i + 5))
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
        )
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r["base_failed"] and r["kept"])


def test_quality_evidence_equals_plain(spark):
    """The mean log ratio, recomputed from the same buckets."""
    import math

    rows = [(i, "good words stay here and there for everyone to read" if i % 2 else "bad&&& words*** stay%%% out|| of### it") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int")
    rules = quality_rules.Rules(buckets=64)
    grams = {r["doc_id"]: r["grams"] for r in quality_rules.with_grams(quality_rules.with_words(docs), 64).collect()}
    raw, target = Counter(b for g in grams.values() for b in g), Counter(b for i, g in grams.items() if i < 10 and i % 2 for b in g)
    ratio = lambda b: math.log((target[b] + 1) / (sum(target.values()) + 64)) - math.log((raw[b] + 1) / (sum(raw.values()) + 64))
    for r in quality_rules.judged(docs, labels, rules).collect():
        assert abs(r["evidence"] - sum(map(ratio, grams[r["doc_id"]])) / len(grams[r["doc_id"]])) < 1e-4


def test_marginals_equal_the_plain_recursion():
    f = toxicity.Field({"=bad": 5.0, "awf": 3.0}, [[0.4, -1.0], [-0.3, 0.6]], -3.0)
    s, r = toxicity.Scorer(f), random.Random(2)
    for _ in range(60):
        words = [r.choice(["bad", "awful", "fine", "day", "x"]) for _ in range(r.randint(1, 12))]
        n, total, each = len(words), 0.0, [0.0] * len(words)
        for code in range(2**n):
            y = [code >> k & 1 for k in range(n)]
            e = [sum(f.weights.get(x, 0) for x in toxicity.features(w)) + f.bias for w in words]
            p = np.exp(sum(f.trans[a][b] for a, b in zip([0, *y], y, strict=False)) + sum(v for v, t in zip(e, y, strict=True) if t))
            total += p
            each = [q + p * t for q, t in zip(each, y, strict=True)]
        at, score, m = s.marked(" ".join(words))
        for i, p in zip(at, s.marginals(at, score, m), strict=True):
            assert abs(p - each[i] / total) < 1e-9


SMALL = "/root/testdata/sf0.01"


def test_toxicity_on_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = toxicity.scored(docs, toxicity.trained(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in rows) >= 0.9 * len(rows)
    text = "you idiot, an Idiot indeed"
    row = toxicity.scored(spark.createDataFrame([(1, text)], "doc_id long, text string"), toxicity.Field({"=idiot": 9.0}, bias=-4.0)).first()
    assert [text[s["start"] : s["end"]].strip(toxicity.STRIPPED).lower() for s in row["spans"]] == ["idiot", "idiot"]


def test_classifier_on_held_out_documents(spark):
    labels = pd.read_parquet(f"{SMALL}/labels.parquet")
    got = queries.op6_quality_classifier(spark, SMALL).toPandas().merge(labels, on="doc_id")
    held = got[[zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]]
    assert held[held["quality"] == 1]["kept"].mean() > 0.95 and held[held["quality"] == 0]["kept"].mean() < 0.3


def test_sparse_sites_shrink(spark):
    rows = [(i, "some words here", "big", "a") for i in range(60)] + [(100, "some words here", "tiny", "a"), (101, "some words here", "new", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(60)] + [(100, 0)], "doc_id long, quality int")
    rates, s = quality_classifier.site_rates(docs, labels)
    by = {r["host"]: r for r in rates.collect()}
    assert abs(by["new"]["path_rate"] - s.mean) < 1e-9 and 0.3 < by["tiny"]["path_rate"] < s.mean


def test_posterior_equals_plain(spark):
    """Each document's rates without its own label, and its posterior, recomputed from counts by the row."""
    import math

    r = random.Random(8)
    rows = [(i, f"some words {i % 7} here and there", f"h{i % 3}", f"p{i % 2}" if i % 11 else None) for i in range(90)]
    marks = {i: int(r.random() < (0.9, 0.5, 0.2)[i % 3]) for i in range(70)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    labels = spark.createDataFrame(list(marks.items()), "doc_id long, quality int")
    _, s = quality_classifier.site_rates(docs, labels)
    assert abs(s.mean - (sum(marks.values()) + 1) / (len(marks) + 2)) < 1e-12
    site, logit = {i: (h, p) for i, _, h, p in rows}, lambda p: math.log(p / (1 - p))
    for x in quality_classifier.classified(docs, labels).collect():
        i = x["doc_id"]
        host = [q for j, q in marks.items() if j != i and site[j][0] == site[i][0]]
        path = [q for j, q in marks.items() if j != i and site[j] == site[i]]
        host_rate = (sum(host) + s.host * s.mean) / (len(host) + s.host)
        path_rate = (sum(path) + s.path * host_rate) / (len(path) + s.path)
        score = 1 / (1 + math.exp(-(x["evidence"] + logit(path_rate) - logit(s.mean))))
        assert abs(x["host_rate"] - host_rate) < 1e-9 and abs(x["path_rate"] - path_rate) < 1e-9 and abs(x["score"] - score) < 1e-9 and x["labelled"] == len(path)


def test_evidence_equals_plain(spark):
    """Naive Bayes odds of words, pairs, shapes and repeats, from the counts of the folds that give them."""
    rows = [(i, "plain words of good sense stay here" if i % 2 else "BAD!! BAD!! stuff%% stuff%% | again again") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    cfg = quality_classifier.Settings(buckets=128)
    model = quality_classifier.fitted(docs, labels, cfg)
    grams = {r["doc_id"]: r["grams"] for r in quality_classifier.with_grams(docs, 128).collect()}
    good, bad = Counter(), Counter()
    for i, g in grams.items():
        if zlib.crc32(str(i).encode()) % 5 > 1:
            (good if i % 2 else bad).update(g)
    assert len(grams[1]) == 7 + 6 + 7 + 6
    for b in range(128):
        want = np.log((good[b] + 1) / (good.total() + 128)) - np.log((bad[b] + 1) / (bad.total() + 128))
        assert abs(model.odds[b] - want) < 1e-9
    assert model.slope > 0


def test_urls_of_a_held_out_fold(spark):
    """Addresses of words that the training never saw in that shape, and the regression's chance recomputed."""
    import math

    import xxhash

    rows = url_filter.labelled_urls()
    held = lambda u: zlib.crc32(u.encode()) % 5 == 0
    table = lambda some: url_filter.parts_of(spark.createDataFrame(some, "url string, label int"))
    weights = url_filter.trained(table([x for x in rows if not held(x[0])]))
    right, test = 0, [x for x in rows if held(x[0])]

    def chance(url):
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        grams = [c[i : i + n] for c in (f"^{host}$", f"<{path}>") for n in url_filter.SIZES for i in range(len(c) - n + 1)]
        buckets = [(lambda h: h - (1 << 64) * (h >> 63))(xxhash.xxh64_intdigest(g.encode(), 42)) % url_filter.BUCKETS for g in grams]
        return 1 / (1 + math.exp(-(weights[-1] + sum(weights[b] for b in buckets) / math.sqrt(max(1, len(grams))))))

    for url, label in test:
        right += (chance(url) > 0.5) == bool(label)
    assert len(test) > 100 and right >= 0.95 * len(test)
    parts = url_filter.with_grams(table(test[:20])).select("host", "path", url_filter.probability(weights).alias("p")).collect()
    got = {r["host"] + r["path"]: r["p"] for r in parts}
    for url, _ in test[:20]:
        assert abs(got[re.match(r"[^?#]*", url.split("://", 1)[1])[0]] - chance(url)) < 1e-4  # weights have six digits in a plan


def test_hosts_paths_and_rules_equal_sql(spark):
    """The contract's host, path and rule of every page, and of odd addresses, by SQL."""
    odd = ["http://A.Example.NET/en/x?y#z", "http://example.net/en", "x://b.example.com/de/1", "http://q.org/fr/", "HTTP:/no", "a://b://c/d", "://net/x", None, "http://notexample.com/de/", "http://net/", "f://o.net?x/"]
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").unionByName(spark.createDataFrame(list(enumerate(odd, 10**6)), "page_id long, url string"))
    con = duckdb.connect()
    addresses = pages.toPandas()
    con.register("addresses", addresses)
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    con.execute("CREATE TABLE rules (h VARCHAR, p VARCHAR, v VARCHAR)")
    con.executemany("INSERT INTO rules VALUES (?, ?, ?)", rules)
    want = con.sql(r"""
        WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM addresses),
        parts AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut)
        SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
        FROM parts LEFT JOIN rules ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id, host, path
    """).fetchall()
    got = {r["page_id"]: r for r in url_filter.judged_urls(pages, url_filter.labelled_table(spark)).collect()}
    assert len(want) == len(got) == len(addresses)
    for page, host, path, rule, verdict in want:
        assert (got[page]["host"], got[page]["path"], got[page]["rule"]) == (host, path, rule)
        assert got[page]["verdict"] == (verdict or ("block" if got[page]["p_block"] > 0.5 else "allow"))


def test_learnt_urls(spark):
    rows = [(1, "http://casino-bonus.example.com/en/1"), (2, "http://museum.example.com/en/visit")]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judged_urls(spark.createDataFrame(rows, "page_id long, url string"), url_filter.labelled_table(spark)).collect()}
    assert got == {1: "block", 2: "allow"}
