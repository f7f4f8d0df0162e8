"""An index as segments: tables that are written once, and commits that say which of them count.

``segments/<name>`` has four tables: ``notes`` (what became of documents), ``chunks`` with their tokens, ``postings``
in folders by term bucket, a row for a term's chunks of one tier and block, with the range of what they can weigh, and
``terms``, a dictionary of what the postings hold. ``commits/<version>.json``
lists the segments of a version with their counts. A commit is one file that may not be there yet, so that of two
writers of a version one fails, and a writer that dies leaves the version before it in place.

A change writes a small segment and nothing else. A row of an older segment is dead if a later note of its
document names a later version; readers leave such rows out. The dictionary takes dead rows back by negative
counts, so that frequencies are those of a fresh build. Segments of like size are merged, without their dead rows.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.chunking import Sizes
from tessera.operators.lexical import USUAL_LENGTH, B, Inverted
from tessera.operators.scratch import broadcast_if_small
from tessera.operators.search import Corpus

SCHEMA_VERSION = 2
#: Term buckets of an index, fixed when it is begun; characters in a folder of chunks, of which a segment has so many at most; segments of like size that are merged.
BUCKETS, CHARACTERS_IN_PART, MOST_PARTS, MERGED_AT = 16, 1 << 28, 16, 4
#: Chunks of which a term's postings are one row.
CHUNKS_IN_BLOCK = 4096
#: Where tiers of postings end, by ``ratio_of``: low ratios are high impacts, and lie in tier 0.
TIER_ENDS = (0.25, 0.6, 1.2)
#: Slim rows (ids and stamps of about 24 bytes, or terms) that are broadcast at most.
FEW = 1 << 18
TABLES = {
    "notes": "doc_id long, collection string, path string, title string, mtime double, hash string, indexed_at long, indexed_in int, noted_in int, removed boolean",
    "chunks": "chunk_id long, doc_id long, chunk_idx int, content string, heading_path string, start_line int, end_line int, token_count int, "
    "tokens array<string>, dl int, indexed_in int, part int",
    "postings": "term string, indexed_in int, chunk_ids array<bigint>, dls array<int>, positions array<array<int>>, least double, most double, tier int, bucket int",
    "terms": "term string, tier int, df long, cf long, least double, most double, bucket int",
}
COMMIT = "version int, schema_version int, created_at long, buckets int, segments array<struct<name:string,notes:long,chunks:long,net_chunks:long,net_tokens:long,first:int,last:int,parts:int>>"


class Conflict(RuntimeError):
    """Another writer has made this version."""


@dataclass(frozen=True)
class Segment:
    """Rows it holds, and what it adds to the index's chunks and tokens: its own less those that died by it.

    ``first`` is the earliest version that its rows are of, ``last`` the latest that its notes are of.
    """

    name: str
    notes: int
    chunks: int
    net_chunks: int
    net_tokens: int
    first: int
    last: int
    parts: int


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def part_of(doc_id: Column, parts: int) -> Column:
    return F.pmod(doc_id, F.lit(parts)).cast("int")


def doc_of(chunk_id: Column) -> Column:
    return F.shiftright(chunk_id, 20)


@dataclass(frozen=True)
class Snapshot:
    """One version of an index; all its tables are those of that version, whatever is written meanwhile."""

    spark: SparkSession
    root: str
    version: int
    buckets: int
    segments: tuple[Segment, ...]
    created_at: int = 0

    def read(self, segment: Segment, table: str) -> DataFrame:
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.root}/segments/{segment.name}/{table}")

    def alive(self, segment: Segment, rows: DataFrame, doc: Column, noted: bool = False, among: tuple[Segment, ...] | None = None, how: str = "left_anti") -> DataFrame:
        """Rows of a segment that no later note of another one speaks of: of a later indexing, or ``noted``, of any kind."""
        others = [s for s in (among or self.segments) if s.name != segment.name and s.last > segment.first]
        if not others:
            return rows if how == "left_anti" else rows.where(F.lit(False))
        of, by = ("noted_in", "noted_in") if noted else ("indexed_in", "indexed_in")
        notes = reduce(DataFrame.unionByName, [self.read(s, "notes").select(F.col("doc_id").alias("__doc"), F.col(by).alias("__at")) for s in others])
        latest = notes.groupBy("__doc").agg(F.max("__at").alias("__at"))
        latest = F.broadcast(latest) if sum(s.notes for s in others) <= FEW else latest
        return rows.join(latest, (F.col("__doc") == doc) & (F.col("__at") > F.col(of)), how)

    def _every(self, table: Callable[[Segment], DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, map(table, self.segments))

    @property
    def documents(self) -> DataFrame:
        """The last note of each document that is there."""
        return self._every(lambda s: self.alive(s, self.read(s, "notes"), F.col("doc_id"), True)).where("NOT removed").drop("removed")

    def last_id(self) -> int:
        """The largest id that a document has or had: ids aren't given again."""
        return self._every(lambda s: self.read(s, "notes").select("doc_id")).agg(F.coalesce(F.max("doc_id"), F.lit(0)).alias("m")).first()["m"]

    @property
    def chunks(self) -> DataFrame:
        rows = self._every(lambda s: self.alive(s, self.read(s, "chunks").drop("part"), F.col("doc_id")))
        return with_heading(rows)

    def _in_parts_of(self, docs: DataFrame) -> tuple[Callable[[Segment], DataFrame], int]:
        """The chunks of the folders that hold one of some documents (doc_id), and the number of rows that ask."""
        most = max(s.parts for s in self.segments)
        counts = docs.groupBy(part_of(F.col("doc_id"), most).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
        # counts of parts are powers of two, so that a folder of the finest cut names those of the others
        rows = lambda s: self.read(s, "chunks").where(F.col("part").isin(sorted({r["p"] % s.parts for r in counts}))).drop("part")
        return rows, sum(r["n"] for r in counts)

    def chunks_at(self, asked: DataFrame, *columns: str) -> DataFrame:
        """``asked`` (chunk_id, ...) with columns of its chunks; only folders that hold one of them are read."""
        rows, n = self._in_parts_of(asked.select(doc_of(F.col("chunk_id")).alias("doc_id")))
        asked = broadcast_if_small(asked, rows=n)
        found = lambda s: self.alive(s, rows(s).select("chunk_id", "indexed_in", *columns), doc_of(F.col("chunk_id"))).drop("indexed_in")
        return self._every(lambda s: asked.join(found(s), "chunk_id"))

    def chunks_of(self, docs: DataFrame) -> DataFrame:
        """The live chunks of some documents (doc_id)."""
        rows, n = self._in_parts_of(docs)
        docs = broadcast_if_small(docs.select("doc_id").distinct(), rows=n)
        return self._every(lambda s: self.alive(s, rows(s).join(docs, "doc_id", "left_semi"), F.col("doc_id")))

    @property
    def postings(self) -> DataFrame:
        """term, chunk_id, dl, tf, positions of all live chunks."""
        each = self._every(lambda s: self.alive(s, exploded(self.read(s, "postings"), "term", "indexed_in"), doc_of(F.col("chunk_id"))))
        return each.drop("indexed_in")

    @property
    def tables(self) -> dict[str, DataFrame]:
        return {"documents": self.documents, "chunks": self.chunks, "postings": self.postings}

    def statistics(self) -> DataFrame:
        """n, avgdl and tokens of the live chunks, by the counts of the commit: no table is read."""
        n, tokens = sum(s.net_chunks for s in self.segments), sum(s.net_tokens for s in self.segments)
        return self.spark.sql(f"SELECT CAST({n} AS BIGINT) AS n, CAST({tokens / n if n else 0.0!r} AS DOUBLE) AS avgdl, CAST({tokens} AS BIGINT) AS tokens")

    def corpus(self, embeddings: DataFrame | None = None) -> Corpus:
        """What ``search`` needs; vectors are those given, or those of ``vectors``."""
        return Corpus(self.chunks, self.inverted(), self.statistics(), embeddings, self.documents, self.chunks_at)

    def inverted(self) -> Inverted:
        """The index for the search, which reads the folders of what it asks for."""

        def terms(asked: DataFrame) -> DataFrame:
            counts = asked.groupBy(bucket_of(F.col("term"), self.buckets).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
            rows = self._every(lambda s: self.read(s, "terms").where(F.col("bucket").isin(sorted(r["b"] for r in counts)))).drop("bucket")
            held = rows.join(broadcast_if_small(asked, rows=sum(r["n"] for r in counts)), "term", "left_semi")
            summed = held.groupBy("term", "tier").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"), F.min("least").alias("least"), F.max("most").alias("most"))
            return summed.where("df > 0")

        def postings(wanted: DataFrame) -> DataFrame:
            keyed = wanted.withColumn("bucket", bucket_of(F.col("term"), self.buckets))
            counts = keyed.groupBy("bucket", "tier").agg(F.count(F.lit(1)).alias("n")).collect()
            folders = sorted((r["tier"], r["bucket"]) for r in counts)
            inside = [(F.col("tier") == t) & F.col("bucket").isin([b for u, b in folders if u == t]) for t in sorted({t for t, _ in folders})]
            rows = lambda s: self.read(s, "postings").where(reduce(lambda a, b: a | b, inside, F.lit(False)))
            keyed = broadcast_if_small(keyed, rows=sum(r["n"] for r in counts))
            met = lambda s: exploded(rows(s).join(keyed, ["bucket", "tier", "term"]), "indexed_in", *wanted.drop("tier").columns)
            return self._every(lambda s: self.alive(s, met(s), doc_of(F.col("chunk_id")))).drop("indexed_in")

        return Inverted(terms, postings, lambda asked: self.chunks_at(asked, "tokens"))


def _filesystem(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def repaired(spark: SparkSession, root: str) -> int:
    """Remove commits that a writer began and never ended, and segments that no commit names; how many commits went.

    Not while a writer is at work.
    """
    at, fs = _filesystem(spark, f"{root}/commits")
    whole = {f"{r['version']}.json" for r in spark.read.schema(COMMIT).json(f"{root}/commits").where("segments IS NOT NULL").select("version").collect()}
    broken = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName()[:1].isdigit() and s.getPath().getName() not in whole]
    for path in broken:
        fs.delete(path, False)
    named = {r["n"] for r in spark.read.schema(COMMIT).json(f"{root}/commits").select(F.explode("segments.name").alias("n")).distinct().collect()}
    at, fs = _filesystem(spark, f"{root}/segments")
    for path in [s.getPath() for s in fs.listStatus(at) if s.getPath().getName() not in named]:
        fs.delete(path, True)
    return len(broken)


def current(spark: SparkSession, root: str) -> Snapshot | None:
    """The latest complete version; None where there is no index yet. Reads only."""
    try:
        commits = spark.read.schema(COMMIT).json(f"{root}/commits")
        row = commits.where("version IS NOT NULL AND segments IS NOT NULL").orderBy(F.col("version").desc()).first()
    except AnalysisException:
        return None
    if row is None:
        return None
    if row["schema_version"] > SCHEMA_VERSION:
        raise ValueError(f"the index has schema {row['schema_version']}, this library knows {SCHEMA_VERSION}")
    return Snapshot(spark, root, row["version"], row["buckets"], tuple(Segment(**s.asDict()) for s in row["segments"]), row["created_at"])


def committed(spark: SparkSession, root: str, version: int, segments: tuple[Segment, ...], buckets: int, now: int) -> Snapshot:
    """Make a version of some segments; ``Conflict`` if it is there already."""
    line = json.dumps({"version": version, "schema_version": SCHEMA_VERSION, "created_at": now, "buckets": buckets, "segments": [asdict(s) for s in segments]})
    at, fs = _filesystem(spark, f"{root}/commits/{version}.json")
    try:
        out = fs.create(at, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e.java_exception):
            raise Conflict(f"version {version} of {root} is there already") from e
        raise
    out.write(bytearray(line.encode()))
    out.close()
    return Snapshot(spark, root, version, buckets, segments, now)


def new_name() -> str:
    return uuid.uuid4().hex


def exploded(blocks: DataFrame, *kept: str) -> DataFrame:
    """The postings of blocks one by one: ``kept``, chunk_id, dl, tf, positions."""
    each = blocks.select(*kept, F.explode(F.arrays_zip("chunk_ids", "dls", "positions")).alias("p"))
    return each.select(*kept, F.col("p.chunk_ids").alias("chunk_id"), F.col("p.dls").alias("dl"), F.size("p.positions").alias("tf"), F.col("p.positions").alias("positions"))


def _grouped(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Values as lists that begin at ``starts``."""
    return pa.ListArray.from_arrays(pa.array(np.r_[starts, len(values)], pa.int32()), pa.array(values, kind) if isinstance(values, np.ndarray) else values)


def _blocks(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The postings of a batch of chunks (chunk_id, dl, indexed_in, tokens): a row for each term, tier and version."""
    ids, dls, versions = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
    tokens = batch.column(3)
    coded = tokens.flatten().dictionary_encode()
    owner = pc.list_parent_indices(tokens).to_numpy().astype(np.int64)
    starts = np.cumsum(np.r_[0, np.bincount(owner, minlength=len(ids))])[:-1]
    place = np.arange(len(owner)) - starts[owner]
    posting, at, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(ids) + owner, return_inverse=True, return_counts=True)
    term, chunk = posting // len(ids), posting % len(ids)
    ratio = (1 - B + B * dls[chunk] / USUAL_LENGTH) / tf
    tier = np.searchsorted(np.array(TIER_ENDS), ratio, "right")
    order = np.lexsort((chunk, versions[chunk], tier, term))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    positions = place[np.lexsort((place, rank[at]))]  # in the order of the postings, each one's ascending
    of_posting = _grouped(positions.astype(np.int32), np.cumsum(np.r_[0, tf[order]])[:-1], pa.int32())
    keys = np.stack([term[order], tier[order], versions[chunk[order]]])
    first = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
    columns = [
        coded.dictionary.take(pa.array(keys[0][first])), pa.array(keys[2][first], pa.int32()), _grouped(ids[chunk[order]], first, pa.int64()),
        _grouped(dls[chunk[order]].astype(np.int32), first, pa.int32()), _grouped(of_posting, first, pa.list_(pa.int32())),
        pa.array(np.minimum.reduceat(ratio[order], first)), pa.array(np.maximum.reduceat(ratio[order], first)), pa.array(keys[1][first], pa.int32()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["term", "indexed_in", "chunk_ids", "dls", "positions", "least", "most", "tier"])


def postings_of(chunks: DataFrame, buckets: int) -> DataFrame:
    """The postings of chunks with tokens, in blocks as they are read; positions are from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNKS_IN_BLOCK):
                part = batch.slice(at, CHUNKS_IN_BLOCK)
                if len(part.column(3).flatten()):
                    yield _blocks(part)

    made = chunks.select("chunk_id", "dl", "indexed_in", "tokens").mapInArrow(
        run, "term string, indexed_in int, chunk_ids array<bigint>, dls array<int>, positions array<array<int>>, least double, most double, tier int"
    )
    return made.withColumn("bucket", bucket_of(F.col("term"), buckets)).select([c.split(" ")[0] for c in TABLES["postings"].split(", ")])


def dictionary(postings: DataFrame) -> DataFrame:
    """What there is to read of each term and tier, a row for each block; readers sum them."""
    cf = F.aggregate("positions", F.lit(0).cast("long"), lambda n, p: n + F.size(p))
    return postings.select("bucket", "term", "tier", F.size("chunk_ids").cast("long").alias("df"), cf.alias("cf"), "least", "most")


def with_heading(chunks: DataFrame) -> DataFrame:
    """Chunks with what is to be embedded of them: their heading's path and content."""
    whole = F.when(F.col("heading_path").isNotNull(), F.concat(F.col("heading_path"), F.lit("\n\n"), F.col("content"))).otherwise(F.col("content"))
    return chunks.withColumn("embedding_content", whole)


def written(
    spark: SparkSession, root: str, notes: DataFrame, chunks: DataFrame, buckets: int, characters: int, dead: DataFrame | None = None, terms: DataFrame | None = None
) -> Segment:
    """Write a segment of notes and chunks of about so many characters, and take back the counts of the chunks that die by it.

    ``terms`` stand for the chunks' own dictionary in a merge; counts are then the caller's.
    """
    name = new_name()
    at = f"{root}/segments/{name}"
    read = lambda table: spark.read.schema(TABLES[table]).parquet(f"{at}/{table}")
    columns = lambda table: [c.split(" ")[0] for c in TABLES[table].split(", ")]
    notes.select(columns("notes")).write.parquet(f"{at}/notes")
    noted = read("notes").agg(F.count(F.lit(1)).alias("n"), F.min("indexed_in").alias("low"), F.max("noted_in").alias("high")).first()
    # every task writes its own file of each part, so that parts are few and texts aren't shuffled
    parts = min(MOST_PARTS, 1 << max(0, math.ceil(math.log2(max(characters, 1) / CHARACTERS_IN_PART))))
    keyed = chunks.withColumn("part", part_of(F.col("doc_id"), parts)).select(columns("chunks"))
    keyed.write.option("compression", "zstd").partitionBy("part").parquet(f"{at}/chunks")
    pieces = read("chunks")
    held = pieces.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t"), F.min("indexed_in").alias("low")).first()
    # every task writes its own run of each bucket, in the order of its terms: nothing is shuffled, and merges join the runs
    posts = postings_of(pieces, buckets).sortWithinPartitions("bucket", "tier", "term")
    posts.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{at}/postings")
    terms = dictionary(read("postings")) if terms is None else terms
    lost = {"n": 0, "t": 0}
    if dead is not None:
        less = [(-F.col(c)).alias(c) for c in ("df", "cf")]
        terms = terms.unionByName(dictionary(postings_of(dead, buckets)).select("bucket", "term", "tier", *less, "least", "most"))
        lost = dead.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t")).first()
    terms.select(columns("terms")).sortWithinPartitions("bucket", "term").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{at}/terms")
    stamps = [v for v in (noted["low"], held["low"]) if v is not None]
    return Segment(name, noted["n"], held["n"], held["n"] - lost["n"], held["t"] - lost["t"], min(stamps, default=0), noted["high"] or 0, parts)


def due(segments: tuple[Segment, ...]) -> tuple[Segment, ...]:
    """Segments of like size, where there are enough of them to merge; the smallest ones first."""
    classes: dict[int, list[Segment]] = {}
    for s in segments:
        classes.setdefault(int(math.log(max(s.chunks, 1), MERGED_AT)), []).append(s)
    return next((tuple(some) for _, some in sorted(classes.items()) if len(some) >= MERGED_AT), ())


def merged(snapshot: Snapshot, some: tuple[Segment, ...], now: int = 0) -> Snapshot:
    """The next version, in which one segment stands for some.

    Rows that died by a note of one of them go; those that died by others' notes stay, and so do counts: the new
    dictionary is the sum of the old ones, which is right whichever rows are still there.
    """
    live = lambda table, doc, noted=False: reduce(DataFrame.unionByName, [snapshot.alive(s, snapshot.read(s, table), doc, noted, some) for s in some])
    rest = tuple(s for s in snapshot.segments if s not in some)
    notes = live("notes", F.col("doc_id"), True)
    if not any(s.first < max(t.last for t in some) for s in rest):
        notes = notes.where("NOT removed")  # nothing is left that these notes speak of
    terms = reduce(DataFrame.unionByName, [snapshot.read(s, "terms") for s in some]).groupBy("bucket", "term", "tier").agg(
        F.sum("df").alias("df"), F.sum("cf").alias("cf"), F.min("least").alias("least"), F.max("most").alias("most")
    )
    chunks = live("chunks", F.col("doc_id")).drop("part")
    made = written(snapshot.spark, snapshot.root, notes, chunks, snapshot.buckets, sum(s.chunks for s in some) * Sizes().target, terms=terms)
    made = replace(made, net_chunks=sum(s.net_chunks for s in some), net_tokens=sum(s.net_tokens for s in some), last=max(s.last for s in some))
    return committed(snapshot.spark, snapshot.root, snapshot.version + 1, (*rest, made), snapshot.buckets, now)
