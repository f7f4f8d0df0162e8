"""A Merkle tree over a dataset: a leaf for each row, a tree for each language, and one over their roots.

Both sweeps are time-forward processing: nodes are met in the order of their labels, and what a node tells others
waits in a priority queue under the label of the one it is for. A label is the last leaf below a node, and then its
level, so that children come before parents and no more messages wait than the tree has levels. Going up, a node
takes its children's digests and sends its own to its parent; going down, labels are met in reverse, and a node
sends each child its proof: the child's sibling, and then the node's own proof.

The queue's external part is Spark's shuffle: leaves are sorted in ranges and numbered, and blocks of so many
neighbours are swept in a task each; the blocks' roots are the leaves of the next round, until one is left. The way
down takes the rounds in reverse, and every block meets its root's proof. Ten thousand million rows are three rounds.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_if_small, placed_within, saved

#: Levels that one round goes up: blocks have two to this power leaves.
BLOCK_LEVELS = 12


def encoded(value: Column) -> Column:
    """A value as the leaves hash it: ``-`` for null, else its UTF-8 bytes' count, a colon and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*values: Column) -> Column:
    """The digest of a row: SHA-256 of its encoded values, in lowercase hex."""
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def joined_digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height_of(n: int) -> int:
    """Levels above n leaves."""
    return max(n - 1, 0).bit_length()


def swept_up(leaves: list[str], height: int) -> dict[tuple[int, int], str]:
    """The digests of a tree of so many levels over some leaves, by (level, place)."""
    nodes: dict[tuple[int, int], str] = {}
    queue: list[tuple[int, int, int, int, str]] = []  # last leaf, level and place of the receiver; place of the sender, digest

    def made(level: int, place: int, digest: str) -> None:
        nodes[level, place] = digest
        if level < height:
            last = min((place // 2 + 1) << (level + 1), len(leaves)) - 1
            heapq.heappush(queue, (last, level + 1, place // 2, place, digest))

    for at, leaf in enumerate(leaves):
        made(0, at, leaf)
        while queue and queue[0][0] <= at:
            label, parts = queue[0][:3], []
            while queue and queue[0][:3] == label:
                parts.append(heapq.heappop(queue)[4])
            made(label[1], label[2], joined_digest(parts))
    return nodes


def swept_down(nodes: dict[tuple[int, int], str], leaves: int, height: int, proof: str) -> list[str]:
    """Each leaf's proof, given the root's: a step for each level, L or R and the sibling's digest, or - where there is none."""
    proofs = [""] * leaves
    last = lambda level, place: min((place + 1) << level, leaves) - 1
    queue = [(-last(height, 0), -height, 0, proof)]
    while queue:
        _, negative, place, known = heapq.heappop(queue)
        level = -negative - 1
        if level < 0:
            proofs[place] = known
            continue
        for child in (2 * place, 2 * place + 1):
            if (level, child) in nodes:
                sibling = nodes.get((level, child ^ 1))
                step = "-" if sibling is None else ("L" if child % 2 else "R") + sibling
                heapq.heappush(queue, (-last(level, child), -level, child, f"{step},{known}" if known else step))
    return proofs


def _block_height(n: int, levels: int) -> int:
    """Levels that a block of a tree with n nodes goes up: all that are left, or as many as a round has."""
    return min(levels, height_of(n))


def _rounds(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """The nodes (tree, pos, n, digest, ...) and those of each round above, the last of which has one for each tree."""
    rounds, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0

    def run(key: tuple, part: pa.Table) -> pa.Table:
        n = part["n"][0].as_py()
        height = _block_height(n, levels)
        root = swept_up(part.sort_by("pos")["digest"].to_pylist(), height)[height, 0]
        return pa.table({"tree": [key[0].as_py()], "pos": [key[1].as_py()], "n": [-(-n >> levels)], "digest": [root]})

    while most > 1:
        blocks = rounds[-1].select("tree", "pos", "n", "digest").groupBy("tree", F.shiftright("pos", levels).alias("block"))
        rounds.append(saved(blocks.applyInArrow(run, "tree string, pos long, n long, digest string")))
        most = -(-most >> levels)
    return rounds


def _proved(rounds: list[DataFrame], roots: DataFrame, levels: int) -> DataFrame:
    """The first round's nodes with ``proof`` and ``subroot``, given those of each tree (tree, proof, subroot)."""
    above = rounds[-1].select("tree", "pos").join(roots, "tree")
    if len(rounds) == 1:
        return rounds[0].join(roots, "tree")

    def run(part: pa.Table, root: pa.Table) -> pa.Table:
        part = part.drop_columns("block").sort_by("pos")
        height = _block_height(part["n"][0].as_py(), levels)
        below = swept_up(part["digest"].to_pylist(), height)
        proofs = swept_down(below, len(part), height, root["proof"][0].as_py())
        same = pa.repeat(root["subroot"][0], len(part))
        return part.append_column("proof", pa.array(proofs, pa.string())).append_column("subroot", same)

    for at, nodes in reversed(list(enumerate(rounds[:-1]))):
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields)
        blocks = nodes.withColumn("block", F.shiftright("pos", levels)).groupBy("tree", "block")
        roots_of = above.select("tree", F.col("pos").alias("block"), "proof", "subroot").groupBy("tree", "block")
        above = blocks.cogroup(roots_of).applyInArrow(run, f"{kinds}, proof string, subroot string")
        above = saved(above) if at else above
    return above


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id", tree: str = "lang",
             carried: dict[str, Column] | None = None, levels: int = BLOCK_LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root and proof of every row, and the ``carried`` columns of the rows.

    A tree's leaves lie by id (null first), then by digest; trees by name (null first, bytes of UTF-8). Nodes pair up
    level by level; a lone last one is hashed alone. ``proof`` has a step for each level from the leaf to the root,
    comma-joined: L or R with the digest of the sibling on that side, or - where there is none; empty where the
    leaf is the root. Rows of equal ids are all kept, and equal rows have equal digests. An empty table gives an
    empty result; extra columns are ignored.
    """
    carried = carried or {}
    name = F.when(F.col(tree).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(tree).cast("string")))
    leaves = saved(docs.select(name.alias("tree"), F.col(key).alias("doc_id"), leaf_of(*[F.col(c) for c in columns]).alias("digest"), *[c.alias(n) for n, c in carried.items()]))
    placed = placed_within(leaves, "tree", ["doc_id", "digest"], "pos")
    sizes = saved(placed.groupBy("tree").agg(F.count(F.lit(1)).alias("n")))
    rounds = _rounds(saved(placed.join(broadcast_if_small(sizes), "tree")), levels)
    # the trees' roots are the leaves of one tree, and are numbered and swept as the others are
    subroots = saved(rounds[-1].select(F.lit("").alias("one"), "tree", "digest"))
    named = placed_within(subroots, "one", ["tree"], "pos").select(F.col("one").alias("tree"), "pos", F.lit(subroots.count()).cast("long").alias("n"), "digest", F.col("tree").alias("name"))
    top = _rounds(saved(named), levels)
    whole = top[-1].first()
    root = whole["digest"] if whole else None
    start = top[-1].select("tree", F.lit("").alias("proof"), F.lit(root).cast("string").alias("subroot"))
    ends = _proved(top, start, levels).select(F.col("name").alias("tree"), "proof", F.col("digest").alias("subroot"))
    found = _proved(rounds, broadcast_if_small(saved(ends)), levels)
    return found.select("doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), "proof", *carried)


def steps(proof: Column) -> Column:
    return F.filter(F.split(proof, ","), lambda s: s != "")


def siblings(proof: Column) -> Column:
    """The digests that a proof holds, from the leaf up, in one text."""
    return F.array_join(F.transform(F.filter(steps(proof), lambda s: s != "-"), lambda s: F.substring(s, 2, 64)), "")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    other = lambda s: F.substring(s, 2, 64)
    up = lambda known, s: F.sha2(F.when(s == "-", known).when(F.startswith(s, F.lit("L")), F.concat(other(s), known)).otherwise(F.concat(known, other(s))), 256)
    return F.aggregate(steps(proof), leaf, up)
