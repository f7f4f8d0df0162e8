"""The Merkle manifest, the ranked search and the shards against plain versions, their SQL and odd rows."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle, queries, ranked_search, sharding
from tessera.llm.common import placed_within, saved

SF = "/root/testdata/sf0.001"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def part(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_ranked_search", "op13_sharding"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    cols = ", ".join(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"SELECT {cols} FROM ({queries.ORACLE_SQL[name]})").fetchall())


# the manifest


def plain_levels(level):
    levels = [level]
    while len(level) > 1:
        level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
        levels.append(level)
    return levels


def plain_steps(levels, at):
    out = []
    for level in levels[:-1]:
        sibling = at ^ 1
        out.append("-" if sibling >= len(level) else ("L" if at % 2 else "R") + level[sibling])
        at >>= 1
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 8, 9, 31, 33, 100])
def test_sweeps_are_a_plain_tree(n):
    leaves = [h(str(i)) for i in range(n)]
    levels = plain_levels(leaves)
    height = merkle.height_of(n)
    nodes = merkle.swept_up(leaves, height)
    assert height == len(levels) - 1 and nodes == {(k, i): d for k, level in enumerate(levels) for i, d in enumerate(level)}
    assert merkle.swept_down(nodes, n, height, "") == [",".join(plain_steps(levels, i)) for i in range(n)]


def plain_manifest(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, h(*[part(v) for v in (r[0], r[3], r[2], r[4], r[1])])))
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    levels = {t: plain_levels([leaf for *_, leaf in sorted(trees[t])]) for t in names}
    top = plain_levels([levels[t][-1][0] for t in names])
    out = []
    for i, t in enumerate(names):
        for at, (known, key, leaf) in enumerate(sorted(trees[t])):
            out.append((key if known else None, leaf, levels[t][-1][0], top[-1][0], ",".join(plain_steps(levels[t], at) + plain_steps(top, i))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("levels", [1, 2, 12])
def test_manifest_of_odd_rows(spark, edge_rows, edge_docs, clashing, levels):
    rows = merkle.manifest(edge_docs, levels=levels)
    assert sorted(map(tuple, rows.collect()), key=repr) == plain_manifest(edge_rows)
    assert sorted(map(tuple, merkle.manifest(clashing, levels=levels).collect()), key=repr) == plain_manifest(edge_rows)
    fold = rows.select("root", "proof", merkle.folded(F.col("leaf"), F.col("proof")).alias("to"), merkle.folded(F.lit("0" * 64), F.col("proof")).alias("bad")).collect()
    assert all(r["to"] == r["root"] != r["bad"] for r in fold)


def test_manifest_of_one_row_and_of_none(spark, no_docs):
    assert merkle.manifest(no_docs).collect() == []
    alone = spark.createDataFrame([(7, "x", None, None, None)], no_docs.schema)
    (row,) = merkle.manifest(alone).collect()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof"] == ""
    assert alone.select(merkle.folded(F.lit("a"), F.lit(""))).first()[0] == "a"


def test_large_ids_keep_all_digits(spark, no_docs):
    ids = [(1 << 60) + i for i in range(9)]
    rows = merkle.manifest(spark.createDataFrame([(i, "t", "en", "s", 1) for i in [*ids, None]], no_docs.schema)).collect()
    assert {r["doc_id"] for r in rows} == {*ids, None}


def test_places_in_groups_of_equal_rows(spark):
    rows = [("a", 1)] * 500 + [("b", i % 3) for i in range(100)] + [("c", 0)]
    placed = placed_within(saved(spark.createDataFrame(rows, "g string, v int").repartition(3)), "g", ["v"], "place").collect()
    for g in "abc":
        mine = sorted((r["place"], r["v"]) for r in placed if r["g"] == g)
        assert [p for p, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted(v for _, v in mine)


# the ranked search


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans(ranked_search.UPPER, ranked_search.LOWER)


def plain_ranked(items, docs, limit=10):
    told = [(d, Counter(TERM.findall((t or "").translate(LOW)))) for d, t in docs]
    told = [(d, c) for d, c in told if c]
    n_docs, tokens = len(told), sum(sum(c.values()) for _, c in told)
    df = Counter(t for _, c in told for t in c)
    wanted = {}
    for i, text in items:
        wanted.setdefault(i, set()).update(TERM.findall((text or "").translate(LOW)))
    out = []
    for i, terms in wanted.items():
        scores = []
        for d, c in told:
            m = 10 + (90 * sum(c.values()) * n_docs) // tokens
            weight = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))  # noqa: E731, B023
            score = sum(weight(t) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)  # noqa: B023
            if score > 0:
                scores.append((-score, d is not None, d or 0))
        out += [(i, k + 1, d if known else None, -s) for k, (s, known, d) in enumerate(sorted(scores)[:limit])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("segment_bytes", [1, 400, 1 << 22])
@pytest.mark.parametrize("in_block", [3, 1 << 16])
def test_ranked_search_of_odd_rows(spark, edge_rows, edge_docs, clashing, segment_bytes, in_block):
    docs = [(r[0], r[1]) for r in edge_rows]
    items = [(1, "word An er, LO mi-ta"), (2, None), (3, "naïve 漢字 x a b c ..."), (3, "mi mi mi su"), (None, "anan lo"), (5, ""), (6, edge_rows[11][1]), (9, "nowhere")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = ranked_search.ranked(asked, edge_docs, segment_bytes=segment_bytes, in_block=in_block)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_ranked(items, docs)
    if in_block == 3:
        more = asked.select("*", *[F.lit("extra").alias(c) for c in ("term", "block", "score", "weight", "ids")])
        assert sorted(map(tuple, ranked_search.ranked(more, clashing, segment_bytes=segment_bytes).collect()), key=repr) == plain_ranked(items, docs)


def test_ranked_search_of_empty_tables(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, "word an")], "item_id long, text string")
    assert ranked_search.ranked(items, no_docs).collect() == []
    assert ranked_search.ranked(items.where("false"), edge_docs).collect() == []
    assert ranked_search.ranked(items, edge_docs.select("doc_id", F.lit(None).cast("string").alias("text"))).collect() == []


@pytest.mark.parametrize("seed", range(8))
def test_nra_reads_until_all_is_resolved(seed):
    r = np.random.default_rng(seed)
    documents, limit = int(r.integers(1, 400)), int(r.integers(1, 12))
    docs, impacts, whole = [], [], np.zeros(documents, np.int64)
    for _ in range(int(r.integers(1, 9))):
        held = np.flatnonzero(r.random(documents) < r.choice([0.02, 0.3, 0.9]))
        value = r.integers(0, 5, len(held)) * r.integers(1, 4)
        order = np.argsort(-value, kind="stable")
        docs.append(held[order])
        impacts.append(value[order].astype(np.int64))
        np.add.at(whole, held, value)
    least = int(r.integers(0, 6))
    found, scores = ranked_search.nra(docs, impacts, documents, limit, least, first_read=int(r.integers(1, 40)))
    kth = max(1, least, np.sort(whole)[-limit] if documents >= limit else 0)
    assert dict(zip(found.tolist(), scores.tolist(), strict=True)) == {i: int(s) for i, s in enumerate(whole) if s >= kth}


def test_nra_leaves_the_rest_of_the_lists_unread():
    """What can't reach the best of earlier segments is not read on."""

    class Watched(np.ndarray):
        read = 0

        def __getitem__(self, key):
            if isinstance(key, slice):
                Watched.read = max(Watched.read, key.stop)
            return super().__getitem__(key)

    lists = [np.arange(10_000).view(Watched) for _ in range(2)]
    falling = np.linspace(1000, 1, 10_000).astype(np.int64)
    found, _ = ranked_search.nra(lists, [falling, falling], 10_000, 10, least=1 << 40, first_read=16)
    assert len(found) == 0 and Watched.read <= 32


# the shards


def plain_shards(rows, shards):
    groups = Counter()
    for _, text in rows:
        groups[text or ""] += len((text or "").encode()) + 8
    heap, shard_of = [(0, i) for i in range(shards)], {}
    for text, total in sorted(groups.items(), key=lambda g: (-g[1], hashlib.sha256(g[0].encode()).digest())):
        load, i = heapq.heappop(heap)
        shard_of[text] = i
        heapq.heappush(heap, (load + total, i))
    return shard_of


def held_to_plain(found, rows, shards):
    shard_of = plain_shards(rows, shards)
    text_of = {}
    for d, t in rows:
        text_of.setdefault((d, zlib.crc32((t or "").encode())), []).append(t or "")
    assert len(found) == len(rows)
    for r in found:
        texts = text_of[r["doc_id"], r["text_crc32"]]
        assert r["size"] == len(texts[0].encode()) + 8 and r["shard"] == shard_of[texts[0]]
    for s in range(shards):
        mine = sorted((r["slot"], r["doc_id"] is not None, r["doc_id"] or 0) for r in found if r["shard"] == s)
        assert [m[0] for m in mine] == list(range(len(mine))) and [m[1:] for m in mine] == sorted(m[1:] for m in mine)


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_shards_of_odd_rows(spark, edge_rows, edge_docs, clashing, shards):
    rows = [(r[0], r[1]) for r in edge_rows]
    held_to_plain(sharding.sharded(edge_docs, shards).collect(), rows, shards)
    held_to_plain(sharding.sharded(clashing, shards).collect(), rows, shards)


def test_shards_of_many_copies_and_equal_sizes(spark, no_docs):
    r = random.Random(4)
    rows = [(i, f"{r.randrange(10**6):06d}" * r.choice((1, 1, 1, 2, 40))) for i in range(3000)] + [(i, "copied " * 5) for i in range(1500)]
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], no_docs.schema)
    found = sharding.sharded(docs).collect()
    held_to_plain(found, rows, 24)
    assert sharding.sharded(no_docs).collect() == []


@pytest.mark.parametrize("seed", range(30))
def test_dealing_in_rounds_is_the_heap_one_by_one(seed):
    r = random.Random(seed)
    shards = r.randint(1, 9)
    classes = [(s, r.choice((1, 2, 3, 50, 700))) for s in sorted({r.randint(1, 10 ** r.randint(1, 4)) for _ in range(r.randint(1, 12))}, reverse=True)]
    heap, want = [(0, i) for i in range(shards)], []
    for size, n in classes:
        for _ in range(n):
            load, i = heapq.heappop(heap)
            want.append(i)
            heapq.heappush(heap, (load + size, i))
    got = []
    for (_, n), (_, firsts, cycles) in zip(classes, sharding.dealt(classes, shards), strict=True):
        assert len(firsts) <= shards + 1 + n % max(1, shards)
        for at in range(n):
            run = sum(f <= at for f in firsts) - 1
            got.append(cycles[run][(at - firsts[run]) % len(cycles[run])])
    assert got == want


def test_sizes_keep_their_leading_bits(spark):
    values = [8, 65535, 65536, 65537, 131073, (1 << 40) + 12345678901]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(sharding.leading(F.col("v"))).collect()]
    assert got == [v >> max(v.bit_length() - 16, 0) << max(v.bit_length() - 16, 0) for v in values]


def test_shards_written(spark, edge_docs, edge_rows, tmp_path):
    at = str(tmp_path / "shards")
    sharding.written(edge_docs, at, shards=3, files=2)
    back = spark.read.parquet(at)
    assert sorted(map(repr, back.select(edge_docs.columns).collect())) == sorted(map(repr, edge_docs.collect()))
    shard_of = plain_shards([(r[0], r[1]) for r in edge_rows], 3)
    assert all(r["shard"] == shard_of[r["text"] or ""] for r in back.collect())
