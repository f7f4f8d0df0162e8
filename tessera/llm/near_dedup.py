"""Near-duplicate detection with SetSketch registers.

1. Each text becomes its set of distinct word shingles and m registers: exponentially spaced, truncated
   minima of hashed shingles, which merge by maximum and agree in a register with about the chance of the
   sets' likeness. Texts with the same set are one class, and its least id stands for it.
2. Bands of registers are hashed into buckets. A bucket's least id is its centre, and all buckets of one
   centre make its group.
3. In a group of bounded size all pairs are estimated jointly by the likelihood of their registers, and what
   may reach the threshold is verified on full sets, in one task.
4. In a larger group every member is verified against one in its middle, found by estimates: the member most
   like the centre. That is about as many pairs as members. What is not yet in one component is told apart
   by shingles within the family, the groups that hang together. Those that many members have form its core.
   Two members that share nothing outside the core can only be linked if both have enough of it for both
   sizes, and if their distances (1 - likeness) from one member of the family, the pivot, differ by no more
   than linked ones lie apart; they meet by bands of that distance. Two that do share something outside it
   meet in a prefix of their rarest shingles, where each key has few members. Both kinds of pairs are
   estimated and then verified on full sets. No link is lost to it.
5. Verified links are joined into components by label propagation with pointer jumping.

Hash functions are fixed, so that reruns agree. The joins are equi-joins whose large keys Spark can split;
the graph lives in tables and never on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import numbered, saved, settled


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    #: Least likeness in percent: 100 * |intersection| >= percent * |union|.
    percent: int = 80
    #: Registers; base and rate of the exponential spacing, and the largest register value.
    registers: int = 256
    base: float = 1.001
    rate: float = 20.0
    largest: int = (1 << 16) - 1
    #: Registers in a band, and the bands that each register is in.
    band: int = 8
    times: int = 3
    #: Standard deviations below the threshold at which an estimate still leads to verification.
    margin: float = 4.5
    #: Groups of up to so many members are compared in one task.
    most_in_task: int = 64
    #: In larger groups, shingles that more members have belong to the core.
    most_sharing: int = 16
    #: Width of the bands of distance from a family's pivot.
    distance_band: float = 0.05


_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX1
    x = (x ^ (x >> np.uint64(33))) * _MIX2
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles: A-Z lower-cased, words by ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    n = len(h) - k + 1
    if n < 1:
        n, k = 1, len(h)
    acc = np.full(n, k, np.uint64)
    for j in range(k):
        acc = acc * _PRIME + h[j : j + n]
    return np.unique(_mixed(acc))


def key_of(s: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(s.tobytes())


@lru_cache
def _multipliers(m: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20240607))
    return tuple(rng.integers(0, 1 << 31, m, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1) for _ in range(2))


def registers(s: np.ndarray, cfg: Settings) -> np.ndarray:
    """The sketch of a set that isn't empty."""
    a, b = _multipliers(cfg.registers)
    low = np.full(cfg.registers, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(s), 1024):
        part = s[at : at + 1024]
        high, rest = (part >> np.uint64(32)).astype(np.uint32)[None, :], part.astype(np.uint32)[None, :]
        np.minimum(low, (high * a + rest * b).min(axis=1), out=low)
    exponential = -np.log1p(-(low + 0.5) / 2**32) / cfg.rate
    return np.clip(np.floor(1 - np.log(exponential) / np.log(cfg.base)), 0, cfg.largest).astype(np.uint16)


@lru_cache
def _bands(m: int, r: int, times: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(7))
    return np.concatenate([rng.permutation(m)[: m // r * r].reshape(-1, r) for _ in range(times)])


def estimate(u: np.ndarray, v: np.ndarray, nu: np.ndarray, nv: np.ndarray, cfg: Settings) -> np.ndarray:
    """Likeliest Jaccard similarity of pairs of sketches (rows), given the sizes of their sets."""
    more, less = (u > v).sum(axis=1)[:, None], (u < v).sum(axis=1)[:, None]
    same = u.shape[1] - more - less
    share = (nu / (nu + nv))[:, None]
    grid = np.linspace(0, 1, 201)[None, :] * np.minimum(share / (1 - share), (1 - share) / share)

    def chance(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (cfg.base - 1) / cfg.base) / np.log(cfg.base), 1e-12, 1)

    up, down = chance(share - (1 - share) * grid), chance((1 - share) - share * grid)
    score = more * np.log(up) + less * np.log(down) + same * np.log(np.clip(1 - up - down, 1e-12, 1))
    return np.take_along_axis(np.broadcast_to(grid, score.shape), score.argmax(axis=1)[:, None], 1)[:, 0]


def sketches(docs: DataFrame, cfg: Settings) -> DataFrame:
    """doc_id, n (set size), key (hash of the set; null if empty), regs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, keys, regs = [], [], []
            for text in pdf["text"]:
                s = shingle_set(text, cfg.shingle)
                n.append(len(s))
                keys.append(key_of(s) if len(s) else None)
                regs.append(registers(s, cfg).tobytes() if len(s) else None)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n": n, "key": keys, "regs": regs})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, n long, key string, regs binary")


def banded(reps: DataFrame, cfg: Settings) -> DataFrame:
    """band, id, n: each class once for each of its bands."""
    places = _bands(cfg.registers, cfg.band, cfg.times)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 1000):
                pdf = whole.iloc[at : at + 1000]
                u = np.frombuffer(b"".join(pdf["regs"]), np.uint16).reshape(len(pdf), -1).astype(np.uint64)
                acc = np.broadcast_to(np.arange(len(places), dtype=np.uint64)[None, :], (len(pdf), len(places)))
                for j in range(cfg.band):
                    acc = _mixed(acc * _PRIME + u[:, places[:, j]])
                yield pd.DataFrame({
                    "band": acc.astype(np.int64).ravel(),
                    "id": np.repeat(pdf["id"].to_numpy(np.int64), len(places)),
                    "n": np.repeat(pdf["n"].to_numpy(np.int64), len(places)),
                })

    return reps.select("id", "n", "regs").mapInPandas(run, "band long, id long, n long")


def _linked(a: np.ndarray, b: np.ndarray, cfg: Settings) -> bool:
    """Whether two sets are linked."""
    small, large = (a, b) if len(a) < len(b) else (b, a)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= cfg.percent * (len(a) + len(b) - both)


def _line(cfg: Settings) -> float:
    """The estimate below which a pair isn't verified."""
    p = cfg.percent / 100
    return p - cfg.margin * (p * (1 - p) / cfg.registers) ** 0.5


def _groups_linked(members: DataFrame, cfg: Settings) -> DataFrame:
    """Links (a, b) that join the members (c, id, n, regs, text) of each bounded group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids, n = pdf["id"].tolist(), pdf["n"].to_numpy(float)
        u = np.frombuffer(b"".join(pdf["regs"]), np.uint16).reshape(len(ids), -1)
        a, b = np.triu_indices(len(ids), 1)
        fit = 100 * np.minimum(n[a], n[b]) >= cfg.percent * np.maximum(n[a], n[b])
        a, b = a[fit], b[fit]
        near = estimate(u[a], u[b], n[a], n[b], cfg) if len(a) else np.empty(0)
        top = list(range(len(ids)))
        sets: dict[int, np.ndarray] = {}

        def root(i: int) -> int:
            while top[i] != i:
                top[i] = top[top[i]]
                i = top[i]
            return i

        def own(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_set(pdf["text"].iat[i], cfg.shingle)
            return sets[i]

        out = []
        for k in np.argsort(-near, kind="stable").tolist():
            if near[k] < _line(cfg):
                break
            i, j = root(int(a[k])), root(int(b[k]))
            if i != j and _linked(own(int(a[k])), own(int(b[k])), cfg):
                top[max(i, j)] = min(i, j)
                out.append((ids[a[k]], ids[b[k]]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return members.groupBy("c").applyInPandas(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, cfg: Settings) -> DataFrame:
    """The pairs (x, c) that full sets show to be linked, as links (a, b)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, last_set = None, np.empty(0, np.uint64)
        for pdf in batches:
            out = []
            for x, c, tx, tc in zip(pdf["x"], pdf["c"], pdf["tx"], pdf["tc"], strict=True):
                if tc != last:
                    last, last_set = tc, shingle_set(tc, cfg.shingle)
                own = shingle_set(tx, cfg.shingle)
                if _linked(own, last_set, cfg):
                    out.append((x, c))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    joined = (
        pairs.join(texts.select(F.col("id").alias("x"), F.col("text").alias("tx")), "x")
        .join(texts.select(F.col("id").alias("c"), F.col("text").alias("tc")), "c")
        .select("x", "c", "tx", "tc")
    )
    return joined.mapInPandas(run, "a long, b long")


def _shingles(members: DataFrame, cfg: Settings) -> DataFrame:
    """g, id, n, at, s for each shingle of each member (g, id, n, at, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                yield pd.DataFrame({"g": r.g, "id": r.id, "n": r.n, "at": r.at, "s": shingle_set(r.text, cfg.shingle).astype(np.int64)})

    return members.select("g", "id", "n", "at", "text").mapInPandas(run, "g long, id long, n long, at long, s long")


def _distances(sized: DataFrame, held: DataFrame) -> DataFrame:
    """``sized`` with ``far``: the Jaccard distance of each member from its family's pivot.

    The pivot is the member with the most of the core. Distances are exact; by the triangle inequality those of
    two members differ by at most their own distance.
    """
    pivot = sized.groupBy("g").agg(F.max_by(F.struct("id", "n"), F.struct("core", -F.col("id"))).alias("p")).select("g", F.col("p.id").alias("id"), F.col("p.n").alias("pn"))
    own = held.join(pivot, ["g", "id"]).select("g", "s", "pn").distinct()
    both = held.select("g", "id", "s").join(own, ["g", "s"]).groupBy("g", "id").agg(F.count(F.lit(1)).alias("both"), F.max("pn").alias("pn"))
    likeness = F.coalesce(F.col("both") / (F.col("n") + F.col("pn") - F.col("both")), F.lit(0.0))
    return sized.join(both, ["g", "id"], "left").withColumn("far", 1 - likeness).drop("both", "pn")


def components(links: DataFrame) -> DataFrame:
    """id, component (least id that links reach) for every id in the table (a, b) of links; a saved table."""
    spark = links.sparkSession
    edges = saved(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())

    def lowered(labels: DataFrame) -> DataFrame:
        """Each label after one look at the neighbours and one jump, beside what it was."""
        near = (
            edges.join(labels.select(F.col("id").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("component").alias("near"))
        )
        lower = saved(labels.join(near, "id").select("id", F.least("component", "near").alias("to"), F.col("component").alias("was")))
        return (
            lower.alias("l")
            .join(lower.select(F.col("id").alias("to"), F.col("to").alias("further")), "to", "left")
            .select("id", F.least("to", F.coalesce("further", "to")).alias("component"), "was")
        )

    labels = saved(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).select(F.col("a").alias("id"), "component"))
    while True:
        jumped = settled(spark, partial(lowered, labels))
        labels = jumped.select("id", "component")
        if jumped.where("component <> was").isEmpty():
            return labels


def _likely(pairs: DataFrame, cfg: Settings) -> DataFrame:
    """x, c, near: the likeliest similarity of pairs (x, c) that carry their registers and sizes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 2000):
                pdf = whole.iloc[at : at + 2000]
                u, v = (np.frombuffer(b"".join(pdf[c]), np.uint16).reshape(len(pdf), -1) for c in ("ux", "uc"))
                near = estimate(u, v, pdf["nx"].to_numpy(float), pdf["nc"].to_numpy(float), cfg)
                yield pdf[["x", "c"]].assign(near=near)

    return pairs.select("x", "c", "ux", "uc", "nx", "nc").mapInPandas(run, "x long, c long, near double")


def _estimated(pairs: DataFrame, regs: DataFrame, cfg: Settings) -> DataFrame:
    """x, c, near for pairs (x, c)."""
    side = lambda i, s: regs.select(F.col("id").alias(i), F.col("regs").alias(f"u{s}"), F.col("n").alias(f"n{s}"))
    return _likely(pairs.join(side("x", "x"), "x").join(side("c", "c"), "c"), cfg)


def _families(large: DataFrame) -> DataFrame:
    """(g, id): all members and centres of the groups (x, c) that hang together, under their least id.

    Each x stays with its least centre, and its other centres are tied to that one: the same components with
    about one edge for each member.
    """
    least = saved(large.groupBy("x").agg(F.min("c").alias("m")))
    tied = large.join(least, "x").where("c <> m").select(F.col("c").alias("a"), F.col("m").alias("b")).distinct()
    return components(least.select(F.col("x").alias("a"), F.col("m").alias("b")).unionByName(tied)).select(F.col("component").alias("g"), "id")


def _around_middles(large: DataFrame, families: DataFrame, reps: DataFrame, cfg: Settings) -> DataFrame:
    """Pairs (x, c) of each member and one in the middle of its group, and of the middles of a family with the least.

    The middle is most like the centre, to a twentieth: a copy is the more like another the less either was
    changed. A member goes to the middle of the centre that it is most like.
    """
    near = saved(_estimated(large, reps, cfg))
    middle = saved(near.groupBy("c").agg(F.max_by("x", F.struct(F.floor(F.col("near") * 20), -F.col("x"))).alias("m")))
    own = near.groupBy("x").agg(F.max_by("c", F.struct("near", -F.col("c"))).alias("c")).join(middle, "c").select("x", F.col("m").alias("c"))
    centres = middle.select(F.col("c").alias("x"), F.col("m").alias("c"))
    placed = middle.select(F.col("m").alias("id")).distinct().join(families, "id")
    tied = placed.join(placed.groupBy("g").agg(F.min("id").alias("c")), "g").select(F.col("id").alias("x"), "c")
    return own.union(centres).union(tied).where("x <> c").distinct()


def _told_apart(families: DataFrame, texts: DataFrame, links: DataFrame, cfg: Settings) -> DataFrame:
    """Pairs (x, c) of members of one family (g, id) that may be linked, by estimate too, and aren't in one component yet."""
    found = components(links)
    placed = saved(families.join(texts.select("id", "n"), "id").join(found, "id", "left").select("g", "id", "n", F.coalesce("component", "id").alias("at")))
    split = placed.groupBy("g").agg(F.countDistinct("at").alias("k")).where("k > 1").select("g")
    main = placed.groupBy("g", "at").agg(F.count(F.lit(1)).alias("k")).groupBy("g").agg(F.max_by("at", F.struct("k", "at")).alias("main"))
    placed = saved(placed.join(split, "g", "left_semi").join(main, "g"))
    held = saved(_shingles(texts.select("id", "text").join(placed, "id").select("g", "id", "n", "at", "text"), cfg))
    common = saved(held.groupBy("g", "s").agg(F.count(F.lit(1)).alias("sharing"), F.min("id").alias("one")))
    few = common.where((F.col("sharing") > 1) & (F.col("sharing") <= cfg.most_sharing)).select("g", "s", "sharing")
    rare = saved(held.join(few, ["g", "s"]))
    alone = common.where("sharing = 1").groupBy("g", F.col("one").alias("id")).agg(F.count(F.lit(1)).alias("alone"))
    shared = rare.groupBy("g", "id").agg(F.count(F.lit(1)).alias("shared"))
    sized = saved(
        placed.join(alone, ["g", "id"], "left").join(shared, ["g", "id"], "left").na.fill(0, ["alone", "shared"])
        .withColumn("core", F.greatest(F.col("n") - F.col("alone") - F.col("shared"), F.lit(0)))
    )
    sized = saved(_distances(sized, held))
    p, whole = cfg.percent, 100 + cfg.percent
    ratio = F.least("n", "n2") * 100 >= F.greatest("n", "n2") * p

    # pairs that share shingles outside the core: a partner has p percent of the size at least; a member's own come first
    place = F.row_number().over(Window.partitionBy("g", "id").orderBy("sharing", "s")) + F.col("alone")
    need = F.greatest(F.ceil(F.col("n") * p / 100) - F.col("core"), F.lit(1))
    prefix = (
        rare.select("g", "id", "s", "sharing").join(sized, ["g", "id"]).withColumn("place", place)
        .where(F.col("place") <= F.col("alone") + F.col("shared") - need + 1).select("g", "s", "id", "n", "at")
    )
    other = prefix.select("g", "s", F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("at").alias("at2"))
    sharing = prefix.join(other, ["g", "s"]).where((F.col("id") < F.col("id2")) & (F.col("at") != F.col("at2")) & ratio)

    # pairs with enough of the core for both, as far from the pivot; one of them is outside the family's main component
    least = sized.groupBy("g").agg(F.min("n").alias("least"))
    enough = lambda core: core * whole >= (F.col("n") + F.col("n2")) * p
    reach, width = 1 - p / 100 + 1e-9, cfg.distance_band
    band = lambda far: F.floor(far / width).cast("int")
    minor = sized.where("at <> main").join(least, "g").where(F.col("core") * whole >= (F.col("n") + F.col("least")) * p)
    minor = minor.join(texts.select("id", F.col("regs").alias("ux")), "id")
    bands = F.sequence(band(F.greatest(F.col("far") - reach, F.lit(0.0))), band(F.col("far") + reach))
    minor = minor.withColumn("band", F.explode(bands))
    major = sized.where(F.col("core") * 100 >= F.col("n") * p).join(texts.select("id", F.col("regs").alias("uc")), "id").select(
        "g", F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("at").alias("at2"), F.col("core").alias("core2"), F.col("far").alias("far2"), "uc",
        band(F.col("far")).alias("band"),
    )
    within = minor.join(major, ["g", "band"]).where(
        (F.col("at") != F.col("at2")) & ratio & enough(F.col("core")) & enough(F.col("core2")) & ((F.col("at2") == F.col("main")) | (F.col("id") < F.col("id2")))
        & (F.abs(F.col("far") - F.col("far2")) <= reach)
    )
    found = _estimated(sharing.select(F.col("id").alias("x"), F.col("id2").alias("c")).distinct(), texts, cfg).union(
        _likely(within.select(F.col("id").alias("x"), F.col("id2").alias("c"), "ux", "uc", F.col("n").alias("nx"), F.col("n2").alias("nc")), cfg)
    )
    return found.where(F.col("near") >= _line(cfg)).select(F.least("x", "c").alias("x"), F.greatest("x", "c").alias("c")).distinct()


def _of_their_sets(held: DataFrame, cfg: Settings) -> DataFrame:
    """id, n, regs, text of rows (id, n, regs, key, several, text): those of ``several`` only if the text's set has the key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fit = [not more or key_of(shingle_set(text, cfg.shingle)) == key for more, key, text in zip(pdf["several"], pdf["key"], pdf["text"], strict=True)]
            yield pdf.loc[fit, ["id", "n", "regs", "text"]]

    some = held.where("several").mapInPandas(run, "id long, n long, regs binary, text string")
    return held.where("NOT several").select("id", "n", "regs", "text").unionByName(some)


def links_of(docs: DataFrame, reps: DataFrame, cfg: Settings) -> DataFrame:
    """Verified links (a, b) between classes (key, owner, id, n, regs, several): enough of them for all components."""
    # the sides of these joins grow with the corpus: they are never to be broadcast
    rows = banded(reps, cfg)
    heads = rows.groupBy("band").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("c")).where("members > 1")
    stars = saved(
        rows.join(heads.select("band", "c").hint("merge"), "band").where("id <> c").select(F.col("id").alias("x"), "c").distinct()
    )
    sizes = saved(stars.groupBy("c").agg(F.count(F.lit(1)).alias("others")))
    small, large = (stars.join(sizes.where(cond), "c", "left_semi") for cond in (F.col("others") < cfg.most_in_task, F.col("others") >= cfg.most_in_task))

    ids = stars.select(F.col("x").alias("id")).union(stars.select("c")).distinct()
    plain = docs.select(F.col("doc_id").cast("long").alias("owner"), "text")
    wanted = reps.join(ids.hint("merge"), "id", "left_semi")
    held = plain.join(wanted.hint("merge"), "owner").select("id", "n", "regs", "key", "several", "text")
    # of the texts of one id, each node has the one that makes its set
    texts = saved(_of_their_sets(held, cfg).dropDuplicates(["id"]))

    members = small.select("c", F.col("x").alias("id")).union(sizes.where(F.col("others") < cfg.most_in_task).select("c", F.col("c").alias("id")))
    links = saved(_groups_linked(members.join(texts.hint("merge"), "id").select("c", "id", "n", "regs", "text"), cfg))
    if not large.isEmpty():
        families = saved(_families(large))
        links = saved(links.unionByName(_verified(_around_middles(large, families, reps, cfg), texts, cfg)))
        close = saved(_told_apart(families, texts, links, cfg))
        links = links.unionByName(saved(_verified(close, texts, cfg)))
    return links


def _with_nodes(reps: DataFrame, sk: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Classes (key, owner, n, regs) with ``id``, their node, and ``several``; links (a, b) of the texts of one id, if there are such.

    A class's node is its least document. Where that one has several texts, the others of its classes get numbers
    of their own beyond all ids, so that every node has one set; nodes of one id are linked, whatever their sets are.
    """
    ids = sk.where("key IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "key")
    several = saved(ids.groupBy("doc_id").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last").select("doc_id"))
    if several.isEmpty():
        return reps.withColumns({"id": F.col("owner"), "several": F.lit(False)}), None
    known = reps.join(several.select(F.col("doc_id").alias("owner"), F.lit(True).alias("several")), "owner", "left")
    first = known.where("several").groupBy("owner").agg(F.min("key").alias("key"))
    more = saved(known.where("several").select("key").join(first.select("key"), "key", "left_anti"))
    bounds = ids.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    at = bounds["high"] if bounds["high"] < 1 << 62 else bounds["low"] - 1 - more.count()
    own = numbered(more, ["key"], "own", at)
    nodes = saved(known.join(own, "key", "left").select("key", "owner", "n", "regs", F.coalesce("own", "owner").alias("id"), F.coalesce("several", F.lit(False)).alias("several")))
    of = saved(ids.join(several, "doc_id", "left_semi").distinct().join(nodes.select("key", "id"), "key").select("doc_id", "id"))
    least = of.groupBy("doc_id").agg(F.min("id").alias("a"))
    return nodes, of.join(least, "doc_id").where("id <> a").select("a", F.col("id").alias("b")).distinct()


def linked_classes(docs: DataFrame, cfg: Settings) -> tuple[DataFrame, DataFrame]:
    """The sketches of all documents, and (key, component) for the classes of equal sets."""
    sk = saved(sketches(docs, cfg))
    reps = saved(
        sk.where("key IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("key")
        .agg(F.min(F.struct("doc_id", "n", "regs")).alias("r"))
        .select("key", F.col("r.doc_id").alias("owner"), F.col("r.n").alias("n"), F.col("r.regs").alias("regs"))
    )
    nodes, same = _with_nodes(reps, sk)

    def found() -> DataFrame:
        links = links_of(docs, nodes, cfg)
        return components(links if same is None else links.unionByName(same))

    labelled = nodes.select("key", "owner", "id").join(settled(docs.sparkSession, found), "id", "left").withColumn("component", F.coalesce("component", "id"))
    if same is None:
        return sk, labelled.select("key", "component")
    # a component goes by its least document, and not by a number beyond the ids
    labelled = saved(labelled)
    least = labelled.groupBy("component").agg(F.min("owner").alias("least"))
    return sk, labelled.join(least, "component").select("key", F.col("least").alias("component"))


def near_duplicates(docs: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Every document's set size, component (least id reachable over links) and whether it is kept.

    Null, empty and wordless texts have no shingles and are linked with nothing. Rows with one id are in one
    component, so that the texts of all of them are linked through it, each by its own set. A row without an id takes no
    part: its component is null and it is kept. Extra columns are ignored; an empty table gives an empty result.
    """
    sk, classes = linked_classes(docs, cfg)
    return (
        sk.select("doc_id", "n", "key")
        .join(classes, "key", "left")
        .select(
            "doc_id", F.col("n").alias("n_shingles"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def deduplicated(docs: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """The documents without those that a link path leads from to a smaller id; all columns."""
    gone = near_duplicates(docs, cfg).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
