"""Packing: order-preserving windows cut by dynamic programming.

Documents in the order of their ids form one stream of tokens per block of ids. A window is at most
``size`` tokens long and may be cut after a document (free), after a sentence or, at spaced places, inside a
long one (at a penalty). The cuts minimise padding plus penalties: the best window that ends at a cut starts
at the least of (cost + place) over the places in reach, which a monotone queue yields in amortised constant
time. A window whose length is a power of two needs no padding; those are tried besides. The end of a
block may be cut anywhere, so that its rest falls into powers of two.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import block_of, range_blocks

#: Splits text into pieces before byte pairs are merged; fixed by the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Settings:
    #: The vocabulary, a byte-level BPE in the tokenizers library's format, without a normaliser and split by the usual
    #: pattern (others are refused); None: byte_bpe_50k.json of public_tokenizers.
    vocabulary: str | None = None
    size: int = 2048
    end_id: int = 1
    #: Costs, in tokens of padding: of a window, of a cut after a sentence, and inside one.
    window_cost: float = 1.0
    sentence_cost: float = 8.0
    inside_cost: float = 32.0
    #: Places inside a sentence longer than this may be cut at its multiples.
    spacing: int = 64
    #: Shortest power-of-two window tried before a block's end.
    least_power: int = 256
    rows_per_block: int = 512
    #: Tokens at which a block's windows so far are settled, but for the last.
    settle: int = 1 << 18


@lru_cache
def encoder(path: str | None):
    """The vocabulary as a tiktoken encoding (several times as fast), and flags by id: ends a sentence, starts with space."""
    import tiktoken

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    steps, bpe = model["pre_tokenizer"] or {}, model["model"]
    if model["normalizer"] or (steps.get("type"), steps.get("add_prefix_space"), steps.get("use_regex")) != ("ByteLevel", False, True):
        raise ValueError(f"{path} normalises or splits text in another way than byte-level pairs do")
    if bpe["type"] != "BPE" or bpe.get("continuing_subword_prefix") or bpe.get("end_of_word_suffix") or bpe.get("ignore_merges"):
        raise ValueError(f"{path} isn't a plain byte-level BPE")
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in bpe["vocab"].items() if token not in special}
    top = max([*ranks.values(), *special.values()]) + 1
    ends, spaced = np.zeros(top, bool), np.zeros(top, bool)
    for token, i in ranks.items():
        ends[i] = token.rstrip(b"\"')] \n").endswith((b".", b"!", b"?")) or b"\n" in token
        spaced[i] = token[:1] in (b" ", b"\n")
    encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return encoding, ends, spaced, tuple(special)


def token_ids(text: str, cfg: Settings) -> np.ndarray:
    """A document's ids, the end id last; special tokens' strings in the text count as such."""
    encoding, _, _, special = encoder(cfg.vocabulary)
    if any(s in text for s in special):
        ids = encoding.encode(text, allowed_special="all")
    else:
        ids = encoding.encode_ordinary(text)
    ids.append(cfg.end_id)
    return np.array(ids, np.uint32)


def places(ids: np.ndarray, doc_ends: np.ndarray, last: bool, cfg: Settings) -> tuple[list[int], list[float]]:
    """Where windows may be cut, in order, with the cost of each; the first is 0 and the last the end."""
    _, ends, spaced, _ = encoder(cfg.vocabulary)
    known = np.minimum(ids, len(ends) - 1)
    after = np.flatnonzero(ends[known[:-1]] & spaced[known[1:]]) + 1
    cost = np.full(len(ids) + 1, np.inf)
    cost[after] = cfg.sentence_cost
    cost[doc_ends] = 0.0
    cost[0] = 0.0
    if last:
        tail = cost[max(0, len(ids) - cfg.size) :]
        np.minimum(tail, cfg.inside_cost, out=tail)
    at = np.flatnonzero(cost < np.inf)
    gaps = np.flatnonzero(np.diff(at) > cfg.spacing)
    for a, b in zip(at[gaps].tolist(), at[gaps + 1].tolist(), strict=True):
        cost[a + cfg.spacing : b : cfg.spacing] = cfg.inside_cost
    at = np.flatnonzero(cost < np.inf)
    return at.tolist(), cost[at].tolist()


def best_cuts(at: list[int], cost: list[float], last: bool, cfg: Settings) -> list[int]:
    """The windows' ends, by least padding and penalties."""
    size, least = cfg.size, 1 if last else cfg.least_power
    powers = [p for p in (1 << k for k in range(size.bit_length())) if least <= p < size]
    best, come = [0.0] * len(at), [0] * len(at)
    where = {p: i for i, p in enumerate(at)}
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])
    for j in range(1, len(at)):
        here = at[j]
        while queue[0][1] < here - size:
            queue.popleft()
        low, _, i = queue[0]
        low += size - here
        for p in powers:
            k = where.get(here - p)
            if k is not None and best[k] < low:
                low, i = best[k], k
        low += cost[j] + cfg.window_cost
        best[j], come[j] = low, i
        low += here
        while queue and queue[-1][0] >= low:
            queue.pop()
        queue.append((low, here, j))
    cuts, j = [], len(at) - 1
    while j > 0:
        cuts.append(at[j])
        j = come[j]
    return cuts[::-1]


class Packer:
    """The stream of one block; documents go in, pieces come out."""

    def __init__(self, block: int, cfg: Settings) -> None:
        self.cfg, self.sequence = cfg, block << 24
        self.docs: list[tuple[int | None, np.ndarray, int, int]] = []  # id, what is left of its ids, ids before, ids in all
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append((doc_id, ids, 0, len(ids)))
        self.held += len(ids)
        if self.held >= self.cfg.settle:
            yield from self.settled(False)

    def settled(self, last: bool) -> Iterator[tuple]:
        if not self.docs:
            return
        ids = np.concatenate([d[1] for d in self.docs])
        ends = np.cumsum([len(d[1]) for d in self.docs])
        cuts = best_cuts(*places(ids, ends, last, self.cfg), last, self.cfg)
        if not last and len(cuts) > 1:
            cuts.pop()
        start, d, within = 0, 0, 0
        for cut in cuts:
            offset = 0
            while start < cut:
                doc_id, left, before, total = self.docs[d]
                n = min(len(left) - within, cut - start)
                piece = left[within : within + n]
                yield doc_id, before + within, n, zlib.crc32(piece.astype("<u4").tobytes()), total, self.sequence, offset, piece
                start, within, offset = start + n, within + n, offset + n
                if within == len(left):
                    d, within = d + 1, 0
            self.sequence += 1
        rest = self.docs[d:]
        if rest and within:
            doc_id, left, before, total = rest[0]
            rest[0] = (doc_id, left[within:], before + within, total)
        self.docs, self.held = rest, len(ids) - start


def packed(docs: DataFrame, cfg: Settings = Settings(), with_ids: bool = True) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids.

    Null text counts as empty: the document is its end id alone. Rows with equal ids are packed each, null
    ids first. Blocks of neighbouring ids are packed apart, each in one task that holds a bounded number of
    tokens besides the document at hand. Extra columns are ignored; an empty table gives an empty result.
    """
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = range_blocks(rows, "doc_id", cfg.rows_per_block)
    if not bounds:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, now, out = None, None, []

        def framed() -> pd.DataFrame:
            pdf = pd.DataFrame([r[: len(columns)] for r in out], columns=columns)
            return pdf.astype({"doc_id": "Int64"})

        for pdf in batches:
            for block, doc_id, text in zip(pdf["block"], pdf["doc_id"], pdf["text"], strict=True):
                if block != now:
                    if packer:
                        out += packer.settled(True)
                    packer, now = Packer(int(block), cfg), block
                out += packer.add(None if pd.isna(doc_id) else int(doc_id), token_ids(text, cfg))
                if len(out) >= 2000:
                    yield framed()
                    out = []
        if packer:
            out += packer.settled(True)
        if out:
            yield framed()

    return (
        rows.withColumn("block", block_of("doc_id", bounds))
        .repartition("block")
        .sortWithinPartitions("block", F.col("doc_id").asc_nulls_first(), "text")
        .mapInPandas(run, schema)
    )
