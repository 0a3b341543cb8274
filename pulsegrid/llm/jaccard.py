"""Exact Jaccard join of documents on word shingles, as a join in metric spaces.

Jaccard distance is a metric, but unrelated documents are all at distance 1 from any pivot: windows of twice
the join radius around Voronoi borders would copy every document to every region. So the first cut is made
in spaces where the windows are narrow, and the Jaccard space is cut inside the regions that this gives.

1. *Size windows.* The size of a set is its distance from the empty set, a pivot of the symmetric difference
   metric. Similar sets have similar sizes; a document belongs to its class of sizes, and to the next
   one if the triangle inequality lets it have partners there.
2. *Slices.* Hashes cut the universe of shingles into more slices than similar sets can differ in, so a similar
   pair is at distance 0 in at least ``SURPLUS`` of them. Every content of a slice is a pivot whose Voronoi region
   are the documents at distance 0; a document that is in fewer regions than a similar pair must share leaves
   them all. (Documents with unusually many empty slices keep these as contents.)
3. *Balls.* The most central document of a region (the one in most regions) becomes its pivot. Each document is measured
   against the pivot it shares most regions with, which links the balls around them. A region whose documents are then all
   connected is done; the documents of the others go on.
4. *Rare shingles.* These documents are in the region of each of their rarest shingles: any similar text has one of them too,
   at a distance of less than 1. Regions overlap and are never merged. Frequencies are counted among
   these documents only, and no text is copied for a region: regions hold ids.
5. *Voronoi regions.* Where few documents are outside a region's largest component, they are measured against the others.
   Any other region is cut by ``PIVOTS`` documents: a document goes to the nearest
   and, by the triangle inequality, to each that is farther by at most twice the radius; parts are regions again, joined the same
   way. Regions that the windows don't part are joined in pairs of blocks, by the lists of documents of each
   shingle of the block, between documents not connected yet.

Exact copies are one document throughout. A slice's content is sent to its bucket once per input shard, however many
documents of the shard have it, so near copies that make up a third of all rows are no burden. Regions hold ids; only documents of some region have their text moved.

* null or empty text, or no words: no shingles, linked with nothing; fewer words than a shingle: all words are one;
* null id: linked with nothing, component null; rows with one id are one document, linked where any of its texts is;
* ties: the smallest id is pivot and component; texts are read whole; extra columns are left out.

Shingles are 64-bit hashes (see :mod:`pulsegrid.llm.text`); 1 - similarity is the distance.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import text as tx
from pulsegrid.llm.components import components
from pulsegrid.llm.store import drop, stored, stored_at

SHARD = 10_000_000  # bytes of text whose documents are represented together, about
ENTRIES = 250_000  # slice contents to a bucket, about
SLICE = 250_000  # bytes of text that are split into words at once, about
OUTPUT = 1_000_000  # bytes of a batch that a shard sends, about; a single row may have more
PASSES = 8  # over the contents of a shard, each with every eighth bucket
RATIO = 1.5  # of the sizes in a class
SURPLUS = 0.15  # share of its slices that a document has in common with any similar one, at least
PIVOTS = 8
COPIES, LARGEST = 1.5, 0.75  # of a region's documents, in all its parts and in one, at most
OUTSIDERS = 32  # documents of a region outside its largest component that are measured one by one
BUCKETS = 4096  # slots that are merged to as many groups as the entries need
BLOCK = 512  # documents of a block
CHUNK = 256  # documents that are measured against one copy of a pivot

DOCS = "doc_id long, n_shingles long, h1 long, h2 long"
CODED = "docs array<struct<doc_id:long,n_shingles:long,h1:long,h2:long>>, bucket int, n long, keys binary, ids binary, region long, doc long"
REGIONS = "region long, doc long"


@dataclass(frozen=True)
class Join:
    """What is joined: shingles of ``words`` words with a similarity of at least ``least``/``of``."""

    words: int = 3
    least: int = 90
    of: int = 100

    def bounds(self) -> list[int]:
        """Smallest size of each class."""
        out = [1]
        while out[-1] < 1 << 40:
            out.append(max(out[-1] + 1, int(out[-1] * RATIO)))
        return out

    def apart(self, size: int) -> int:
        """Most elements in which a set of ``size`` elements differs from a similar one."""
        return size * (self.of - self.least) // self.least

    def slices(self, c: int, bounds: list[int]) -> tuple[int, int]:
        """Number of slices of a class, and how many may be empty. 0 where only equal sets are similar."""
        apart = self.apart(bounds[c + 1] - 1)
        spare = 2 + apart // 40
        return (int(apart / (1 - SURPLUS)) + 1 + spare if apart else 0), spare

    def linked(self, both: int, union: int) -> bool:
        return union > 0 and self.of * both >= self.least * union


def shingle_sets(w: tx.Words, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of each text."""
    for i in range(len(w.bounds) - 1):
        yield np.unique(tx.ngrams(w.hashes[w.bounds[i]:w.bounds[i + 1]], words))


CLASS = tx.U64(127)


class Slicer:
    def __init__(self, join: Join):
        self.join, self.bounds = join, join.bounds()

    def keys(self, s: np.ndarray) -> np.ndarray:
        """Hashes of the set's content in each slice, for each of its classes."""
        n = len(s)
        c = int(np.searchsorted(self.bounds, n, "right")) - 1
        out = []
        mixed = sums = None
        while True:
            slices, spare = self.join.slices(c, self.bounds)
            if slices:
                edges = (np.arange(1, slices, dtype=object) * (1 << 64) // slices).astype(np.uint64) if slices < 3 else \
                    (np.arange(1, slices, dtype=np.uint64) * tx.U64((1 << 64) // slices))
                at = np.concatenate([[0], np.searchsorted(s, edges), [n]])
                if mixed is None:
                    mixed = tx.mix(s ^ tx.U64(0xA5A5A5A5A5A5A5A5))
                    sums = np.zeros(n + 1, tx.U64)
                    with np.errstate(over="ignore"):
                        np.cumsum(mixed, out=sums[1:])
                with np.errstate(over="ignore"):
                    content = tx.mix(sums[at[1:]] - sums[at[:-1]] + tx.mix(np.arange(slices, dtype=np.uint64) + tx.U64(c + 1 << 40)))
                full = at[1:] > at[:-1]
                content = content[full] if slices - full.sum() <= spare else content
                out.append(content & ~CLASS | tx.U64(c))  # the class can be read off
            c += 1
            if self.join.of * n < self.join.least * self.bounds[c]:
                break
        return np.concatenate(out) if out else np.zeros(0, tx.U64)


def _planes(ids: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(np.ascontiguousarray(ids, "<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _from_planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(b), np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _rows(docs=(), blobs=(), regions=None) -> pa.RecordBatch:
    kind = pa.struct([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])
    n = len(regions[0]) if regions else 0
    lists = [docs] * bool(docs) + [None] * (len(blobs) + n)
    pad = [None] * bool(docs)
    columns = [pa.array(lists, pa.list_(kind))]
    for k, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary())):
        columns.append(pa.array(pad + [b[k] for b in blobs] + [None] * n, t))
    for k in range(2):
        lead = pa.nulls(len(pad) + len(blobs), pa.int64())
        columns.append(pa.concat_arrays([lead, pa.array(regions[k], pa.int64()) if regions else pa.nulls(0, pa.int64())]))
    return pa.RecordBatch.from_arrays(columns, ["docs", "bucket", "n", "keys", "ids", "region", "doc"])


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``OUTPUT`` bytes: the JVM holds a batch as a whole, outside its heap."""
    size = np.full(len(batch), 64)  # of the columns of fixed width
    for column in batch.columns:
        if pa.types.is_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy()
        elif pa.types.is_list(column.type):
            size += 32 * pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    ends = np.concatenate([[0], np.cumsum(size)])
    for i, j in tx.slices(ends, OUTPUT):
        yield batch.slice(i, j - i)


def _shared(key: np.ndarray, doc: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """``(key, doc)`` of the keys with several documents, and which entry stands for each key."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(fresh)
    several = np.repeat(np.diff(first, append=len(key)) > 1, np.diff(first, append=len(key)))
    return [key[several].view(np.int64), doc[several]], order[first]


class _Open:
    """Documents of a shard: distinct sets, their keys, and who has them."""

    def __init__(self, slicer: Slicer, buckets: int):
        self.slicer, self.buckets = slicer, buckets
        self.docs, self.reps, self.bytes = [], {}, 0

    def add(self, ids: list, w: tx.Words) -> None:
        self.bytes += len(w.data)
        for doc, s in zip(ids, shingle_sets(w, self.slicer.join.words), strict=True):
            with np.errstate(over="ignore"):
                h1, h2 = int(tx.mix(s).sum(dtype=np.uint64)), int(tx.mix(s ^ tx.U64(0x3C3C3C3C3C3C3C3C)).sum(dtype=np.uint64))
            h1, h2 = h1 - (1 << 63), h2 - (1 << 63)
            self.docs.append((doc, len(s), h1, h2))
            if doc is not None and len(s):
                if (h1, h2) not in self.reps:
                    self.reps[h1, h2] = [doc, self.slicer.keys(s)]
                self.reps[h1, h2][0] = min(doc, self.reps[h1, h2][0])

    def rows(self) -> Iterator[pa.RecordBatch]:
        kinds = ["doc_id", "n_shingles", "h1", "h2"]
        yield from _parts(_rows([dict(zip(kinds, d, strict=True)) for d in self.docs]))
        reps = list(self.reps.values())
        keys = np.concatenate([k for _, k in reps] or [np.zeros(0, tx.U64)])
        docs = np.repeat(np.array([d for d, _ in reps], np.int64), [len(k) for _, k in reps])
        buckets = ((keys >> tx.U64(48)) % tx.U64(self.buckets)).astype(np.int32)
        for k in range(PASSES):
            own = buckets % PASSES == k
            yield from _parts(self.regions(keys[own], docs[own]))

    def regions(self, key: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
        """Regions inside the shard, and by bucket what other shards need to know: that a key is here, not how often."""
        regions, heads = _shared(key, doc)
        key, doc = key[heads], doc[heads]
        bucket = ((key >> tx.U64(48)) % tx.U64(self.buckets)).astype(np.int64)
        order = np.lexsort((doc, bucket))
        key, doc, bucket = key[order], doc[order], bucket[order]
        blobs = []
        for b in np.unique(bucket).tolist():
            at, to = np.searchsorted(bucket, b), np.searchsorted(bucket, b, "right")
            blobs.append((b, to - at, key[at:to].tobytes(), _planes(doc[at:to])))
        return _rows((), blobs, regions)


def _code(join: Join, buckets: int) -> Callable:
    def run(batches):
        slicer = Slicer(join)
        shard = _Open(slicer, buckets)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, j, w in tx.batches_of_words(batch.column(1), limit=SLICE):
                shard.add(ids[i:j], w)
                if shard.bytes >= SHARD:
                    yield from shard.rows()
                    shard = _Open(slicer, buckets)
        if shard.docs:
            yield from shard.rows()
    return tx.tidy(run)


def _meet(_, table):
    """Regions of one bucket: documents of different shards with the same content of a slice."""
    tx.release()
    key = np.concatenate([np.frombuffer(b, tx.U64) for b in table.column("keys").to_pylist()])
    doc = np.concatenate([_from_planes(b) for b in table.column("ids").to_pylist()])
    regions, _ = _shared(key, doc)
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("region", "doc"), regions, strict=True)})


def _alike(regions: DataFrame, sizes: DataFrame, join: Join) -> tuple[DataFrame, str]:
    """``region, doc`` of documents that share as many slices as a similar pair must, and the table's folder.

    A document differs from a similar one in at most ``apart`` elements, so in as many slices; the others are equal,
    and but for the empty ones the two are together in the regions of these.
    """
    bounds = join.bounds()
    rows = zip(*((c, *join.slices(c, bounds)) for c in range(len(bounds) - 1)), strict=True)  # some dozens
    classes = regions.sparkSession.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in rows], ["c", "slices", "spare"])).withColumn("part", F.col("c").cast("int"))
    part = F.col("region").bitwiseAND(F.lit(127)).cast("int")
    counted = regions.withColumn("part", part).groupBy("doc", "part").agg(F.count(F.lit(1)).alias("shared"))
    apart = F.floor(F.col("n_shingles") * (join.of - join.least) / join.least)
    alive = (counted.join(sizes, "doc").join(F.broadcast(classes), "part")
             .where(F.col("shared") >= F.col("slices") - F.col("spare") - apart).select("doc", "part"))
    return stored_at(regions.withColumn("part", part).join(alive, ["doc", "part"], "left_semi").select("region", "doc"), "alike")


def _distinct_sets(regions: DataFrame) -> DataFrame:
    """One of the regions with the same documents, if these are several."""
    sets = regions.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("doc")).alias("x"),
                                         F.bit_xor(F.xxhash64("doc", F.lit(17))).alias("y")).where("n > 1")
    return regions.join(sets.groupBy("n", "x", "y").agg(F.min("region").alias("region")).select("region"), "region", "left_semi")


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` with an id in ``ids``, which are distinct. A bit map of fixed size (2^22 bits, 65,536 rows) keeps most
    other texts from being shuffled; what it lets through by chance the join drops."""
    slot = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 22))
    bits = (ids.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")))
    near = (docs.withColumn("slot", slot).withColumn("word", F.shiftright("slot", 6)).join(F.broadcast(bits), "word")
            .where(F.expr("shiftright(bits, cast(slot & 63 as int)) & 1 = 1")).select("doc_id", "text"))
    # no semi join: Spark moves one below the bit map's join, and then shuffles all texts
    return near.join(ids, "doc_id")


def _measure(words: int) -> Callable:
    def run(batches):
        group, pivots = None, []
        for batch in batches:  # rows come sorted: pivot, chunk, then the pivot's own texts first
            b, chunk, member, a = (batch.column(c).to_pylist() for c in ("b", "chunk", "member", "a"))
            out = [[] for _ in range(4)]
            for i, j, w in tx.batches_of_words(batch.column("text"), limit=SLICE):
                for k, s in zip(range(i, j), shingle_sets(w, words), strict=True):
                    if (b[k], chunk[k]) != group:
                        group, pivots = (b[k], chunk[k]), []
                    if not member[k]:
                        pivots.append(s)
                        continue
                    for p in pivots:
                        both = len(np.intersect1d(s, p, assume_unique=True))
                        for column, value in zip(out, (a[k], b[k], both, len(s) + len(p) - both), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["a", "b", "both", "union"])
    return tx.tidy(run)


def measured(docs: DataFrame, pairs: DataFrame, join: Join) -> DataFrame:
    """``a, b, both, union`` for distinct pairs of ids: sizes of intersection and union (the most similar texts, where
    an id has several). The texts of ``a`` stream past one copy of ``b`` in chunks, however many they are."""
    pairs = stored(pairs, "pairs")
    wide = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    dealt = pairs.join(wide, "b").withColumn("chunk", F.pmod(F.xxhash64("a", F.lit(9)), F.ceil(F.col("n") / CHUNK)))
    dealt = stored(dealt.select("a", "b", "chunk"), "dealt")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts, path = stored_at(texts_of(docs, ids), "texts")
    members = dealt.join(texts.withColumnRenamed("doc_id", "a"), "a").select("b", "chunk", F.lit(1).alias("member"), "a", "text")
    pivots = (dealt.select("b", "chunk").distinct().join(texts.withColumnRenamed("doc_id", "b"), "b")
              .select("b", "chunk", F.lit(0).alias("member"), F.col("b").alias("a"), "text"))
    ordered = members.union(pivots).repartition("b", "chunk").sortWithinPartitions("b", "chunk", "member", "a")
    found = stored(ordered.mapInArrow(_measure(join.words), "a long, b long, both long, union long"), "measured")
    drop(docs, path)
    return found.groupBy("a", "b").agg(F.max_by(F.struct("both", "union"), F.col("both") / F.col("union")).alias("s")).select("a", "b", "s.*")


def _sharded(join: Join, buckets: int) -> Callable:
    """Sets of the texts of a shard in one row, and the shard's distinct shingles with their numbers of texts, by bucket."""
    def rows(shard: int, docs: list, sets: list) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(sets), return_counts=True)
        bucket = (keys >> tx.U64(40)) % tx.U64(buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        some = np.flatnonzero(np.diff(cuts)).tolist()
        parts = [order[cuts[b]:cuts[b + 1]] for b in some]
        return pa.RecordBatch.from_arrays([
            pa.array([shard] * (1 + len(some)), pa.int64()), pa.array([None, *some], pa.int32()),
            pa.array([np.concatenate(sets).tobytes(), *(keys[p].tobytes() for p in parts)], pa.binary()),
            pa.array([np.array([len(s) for s in sets]).tobytes(), *(counts[p].tobytes() for p in parts)], pa.binary()),
            pa.array([np.array(docs, np.int64).tobytes()] + [None] * len(some), pa.binary())], ["shard", "bucket", "keys", "counts", "docs"])

    def run(batches):
        shard, docs, sets, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, j, w in tx.batches_of_words(batch.column(1), limit=SLICE):
                for doc, s in zip(ids[i:j], shingle_sets(w, join.words), strict=True):
                    if len(s):
                        docs.append(doc)
                        sets.append(s)
                size += len(w.data)
                if size >= SHARD // 4 and sets:  # a shard's sets are one row
                    yield from _parts(rows(shard, docs, sets))
                    shard, docs, sets, size = shard + 1, [], [], 0
        if sets:
            yield from _parts(rows(shard, docs, sets))
    return tx.tidy(run)


def _repeated(_, table):
    """For each shard, its shingles of one bucket that several texts have, and how many do."""
    tx.release()
    keys = [np.frombuffer(b, tx.U64) for b in table.column("keys").to_pylist()]
    shard = np.repeat(table.column("shard").to_numpy(), [len(k) for k in keys])
    keys, counts = np.concatenate(keys), np.concatenate([np.frombuffer(b, np.int64) for b in table.column("counts").to_pylist()])
    unique, at = np.unique(keys, return_inverse=True)
    texts = np.bincount(at, counts, len(unique)).astype(np.int64)[at]
    keep = np.flatnonzero(texts > 1)
    keep = keep[np.argsort(shard[keep], kind="stable")]
    names, cuts = np.unique(shard[keep], return_index=True)
    parts = np.split(keep, cuts[1:]) if len(names) else []
    return pa.table({"shard": pa.array(names, pa.int64()), "keys": pa.array([keys[p].tobytes() for p in parts], pa.binary()),
                     "counts": pa.array([texts[p].tobytes() for p in parts], pa.binary())})


def _prefixes(join: Join) -> Callable:
    """The rarest shingles of each text of a shard: one more than a similar text can lack."""
    def run(_, shard, repeated):
        tx.release()
        known = np.concatenate([np.frombuffer(b, tx.U64) for b in repeated.column("keys").to_pylist()] or [np.zeros(0, tx.U64)])
        texts = np.concatenate([np.frombuffer(b, np.int64) for b in repeated.column("counts").to_pylist()] or [np.zeros(0, np.int64)])
        order = np.argsort(known)
        known, texts = np.append(known[order], tx.U64(0)), np.append(texts[order], 1)
        keys, sizes, docs = (np.frombuffer(shard.column(c)[0].as_py(), t) for c, t in (("keys", tx.U64), ("counts", np.int64), ("docs", np.int64)))
        at = np.searchsorted(known[:-1], keys)
        often = np.where(known[at] == keys, texts[at], 1)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((keys, often, owner))
        place = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        longest = sizes + join.least * sizes // -join.of + 1
        kept = order[(place < np.repeat(longest, sizes)) & (often[order] > 1)]
        return pa.table({"region": pa.array(keys[kept].view(np.int64)), "doc": pa.array(docs[owner[kept]])})
    return run


def _lists(docs: DataFrame, ids: DataFrame, join: Join) -> DataFrame:
    """``region, doc``: documents that have one of their rarest shingles in common; each set of documents once.

    Sorted by frequency, the first ``n - least * n / of + 1`` shingles of two similar sets share one, as either lacks too few
    of the other's. Frequencies are those among the given documents, so shingles of shared passages come last and shingles
    of one document lead nowhere. A shard sends its distinct shingles to buckets, and gets back those that several texts have.
    """
    sharded, path = stored_at(texts_of(docs, ids).mapInArrow(_sharded(join, BUCKETS), "shard long, bucket int, keys binary, counts binary, docs binary"), "shards")
    parts = sharded.where("bucket IS NOT NULL")
    groups = max(1, -(-(parts.agg(F.sum(F.octet_length("keys"))).first()[0] or 0) // (8 * ENTRIES)))
    known = (parts.select(F.pmod("bucket", F.lit(groups)).alias("group"), "shard", "keys", "counts").groupBy("group")
             .applyInArrow(_repeated, "shard long, keys binary, counts binary"))
    sets = sharded.where("bucket IS NULL").select("shard", "keys", "counts", "docs")
    lists = stored(sets.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(_prefixes(join), REGIONS).distinct(), "lists")
    drop(docs, path)
    return _distinct_sets(lists)


def _leaf(join: Join) -> Callable:
    def run(_, table):
        tx.release()
        table = table.sort_by("doc")
        rows = {c: table.column(c).to_pylist() for c in ("doc", "component", "block", "inside")}
        sets = [s for _, _, w in tx.batches_of_words(table.column("text").combine_chunks(), limit=SLICE) for s in shingle_sets(w, join.words)]
        size, block = np.array([len(s) for s in sets]), np.array(rows["block"])
        unique, ids = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), size)
        holders = owner[np.argsort(ids, kind="stable")]  # documents of each shingle
        begin = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=len(unique)))])
        start = np.cumsum(size) - size
        root = {c: c for c in rows["component"]}

        def find(c):
            while root[c] != c:
                c = root[c]
            return c

        a, b = [], []
        for i in range(1, len(sets)):
            own = ids[start[i]:start[i] + size[i]]
            many = begin[own + 1] - begin[own]
            at = np.arange(many.sum()) + np.repeat(begin[own] - np.cumsum(many) + many, many)
            both = np.bincount(holders[at], minlength=len(sets))[:i]
            near = (both > 0) & (join.of * both >= join.least * (size[i] + size[:i] - both))
            if not rows["inside"][i]:
                near &= block[:i] != block[i]
            for j in np.flatnonzero(near).tolist():
                x, y = find(rows["component"][i]), find(rows["component"][j])
                if x != y:
                    a.append(rows["doc"][i])
                    b.append(rows["doc"][j])
                    root[max(x, y)] = min(x, y)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def _joined_in_blocks(docs: DataFrame, regions: DataFrame, join: Join) -> DataFrame:
    """Links between unconnected documents of each region; groups are pairs of blocks of about ``BLOCK`` documents."""
    dealt = regions.withColumn("blocks", F.ceil(F.col("size") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("doc", F.lit(3)), "blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = (dealt.withColumn("other", other).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
             .withColumn("inside", F.col("low") == F.col("high")))
    texts = texts_of(docs, regions.select(F.col("doc").alias("doc_id")).distinct()).withColumnRenamed("doc_id", "doc")
    return (dealt.join(texts, "doc").select("region", "low", "high", "doc", "component", "block", "inside", "text")
            .groupBy("region", "low", "high").applyInArrow(_leaf(join), "a long, b long"))


def _voronoi(docs: DataFrame, regions: DataFrame, join: Join) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links to the drawn pivots; the regions that result; and those that the windows don't part."""
    draw = F.pmod(F.xxhash64("doc", F.lit(31)), F.lit(1 << 30))  # overlapping regions draw the same documents
    drawn = regions.withColumn("draw", draw)
    least = drawn.groupBy("region").agg(F.min("draw").alias("least"))
    pivots = (drawn.join(least, "region").where((F.col("draw") == F.col("least")) | (F.col("draw") * F.col("size") < F.lit(PIVOTS << 30)))
              .select("region", F.col("doc").alias("pivot")))
    asked = stored(regions.select("region", "doc").join(pivots, "region").where("doc <> pivot"), "asked")
    far = stored(measured(docs, asked.select(F.col("doc").alias("a"), F.col("pivot").alias("b")).distinct(), join), "distances")
    links = far.where(f"{join.of} * both >= {join.least} * union").select("a", "b")
    at = asked.join(far, (asked["doc"] == far["a"]) & (asked["pivot"] == far["b"])).select(
        "region", "doc", "pivot", (1 - F.col("both") / F.col("union")).alias("d"))
    at = at.join(pivots.select("region", F.col("pivot").alias("doc")), ["region", "doc"], "left_anti")  # pivots are done with
    home = at.groupBy("region", "doc").agg(F.min("d").alias("near"))
    window = 2 * (join.of - join.least) / join.of + 1e-9
    placed = stored(at.join(home, ["region", "doc"]).where(F.col("d") <= F.col("near") + window)
                    .select("region", "doc", F.xxhash64("region", "pivot").alias("part")), "placed")
    size = placed.groupBy("region", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("region").agg(F.sum("n").alias("copies"), F.max("n").alias("largest"))
    weight = size.join(placed.groupBy("region").agg(F.count_distinct("doc").alias("docs")), "region")
    parted = weight.where((F.col("copies") <= F.col("docs") * COPIES) & (F.col("largest") <= F.col("docs") * LARGEST)).select("region")
    into = placed.join(parted, "region", "left_semi").select(F.col("part").alias("region"), "doc")
    whole = placed.join(parted, "region", "left_anti").select("region", "doc").distinct()
    return links, into, whole


def _balls(docs: DataFrame, todo: DataFrame, join: Join) -> DataFrame:
    """Links of the regions' most central documents. A document is measured against the one that it shares most
    regions with: that connects most of what is similar, and moves its text once."""
    central = todo.groupBy("doc").agg(F.count(F.lit(1)).alias("degree"))
    ranked = todo.join(central, "doc").select("region", "doc", "degree")
    most = ranked.groupBy("region").agg(F.max("degree").alias("degree"))
    pivots = ranked.join(most, ["region", "degree"]).groupBy("region").agg(F.min("doc").alias("pivot"))
    pairs = stored(todo.select("region", "doc").join(pivots, "region").where("doc <> pivot")
                   .groupBy(F.col("doc").alias("a"), F.col("pivot").alias("b")).agg(F.count(F.lit(1)).alias("n")), "shared")
    nearest = pairs.join(pairs.groupBy("a").agg(F.max("n").alias("n")), ["a", "n"]).groupBy("a").agg(F.min("b").alias("b"))
    return measured(docs, nearest, join).where(f"{join.of} * both >= {join.least} * union").select("a", "b")


def _main(regions: DataFrame) -> DataFrame:
    """The largest component of each region, and how many documents are outside of it."""
    counts = regions.groupBy("region", "component").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("region").agg(F.max_by("component", "n").alias("main"), (F.sum("n") - F.max("n")).alias("outsiders"))


def _by_outsiders(docs: DataFrame, regions: DataFrame, join: Join) -> DataFrame:
    """Links of regions with few documents outside their largest component: these meet the documents of other components."""
    pairs = (regions.where("component <> main").select("region", F.col("doc").alias("b"), F.col("component").alias("other"))
             .join(regions, "region").where((F.col("component") != F.col("other")) & ((F.col("component") == F.col("main")) | (F.col("b") < F.col("doc"))))
             .select(F.col("doc").alias("a"), "b").distinct())
    return measured(docs, pairs, join).where(f"{join.of} * both >= {join.least} * union").select("a", "b")


def _unfinished(regions: DataFrame, labels: DataFrame) -> DataFrame:
    """Regions with documents of several components, with these and the number of documents."""
    labelled = stored(regions.join(labels, regions["doc"] == labels["node"], "left").select(
        "region", "doc", F.coalesce("component", "doc").alias("component")), "labelled")
    mixed = (labelled.groupBy("region").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("low"), F.max("component").alias("high"))
             .where("low <> high").select("region", "size"))
    return stored(labelled.join(mixed, "region"), "unfinished")


def _with_links(links: DataFrame, labels: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All links and their components; those that were there, where nothing is new."""
    new = stored(new, "links")
    if new.isEmpty():
        return links, labels
    links = links.union(new)
    return links, components(links)


def link_components(docs: DataFrame, join: Join = Join(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row: components of the graph of all similar pairs."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    coded, coded_path = stored_at(docs.mapInArrow(_code(join, BUCKETS), CODED), "coded")
    thin = stored(coded.where("docs IS NOT NULL").select(F.explode("docs").alias("d")).select("d.*"), "documents")
    classes = stored(thin.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("h1", "h2").agg(
        F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")), "classes")
    copies = stored(thin.join(classes.where("rep <> last"), ["h1", "h2"]).where("doc_id <> rep")
                    .select(F.col("doc_id").alias("doc"), "rep").distinct(), "copies")
    blobs = coded.where("bucket IS NOT NULL")
    groups = max(1, -(-(blobs.agg(F.sum("n")).first()[0] or 0) // ENTRIES))
    met = (blobs.select(F.pmod("bucket", F.lit(groups)).alias("group"), "keys", "ids").groupBy("group").applyInArrow(_meet, REGIONS))
    regions = met.union(coded.where("region IS NOT NULL").select("region", "doc")).join(copies, "doc", "left").select(
        "region", F.coalesce("rep", "doc").alias("doc")).distinct()
    sizes = thin.where("n_shingles > 0").groupBy(F.col("doc_id").alias("doc")).agg(F.max("n_shingles").alias("n_shingles"))
    regions, regions_path = stored_at(regions, "regions")
    drop(docs, coded_path)
    alike, alike_path = _alike(regions, sizes, join)
    none = docs.sparkSession.range(0)  # a table made of Python rows would start workers of its own
    labels, links = (none.select(*(F.col("id").alias(c) for c in names)) for names in (("node", "component"), ("a", "b")))
    todo = _unfinished(_distinct_sets(alike), labels)
    for path in (regions_path, alike_path):
        drop(docs, path)
    if not todo.isEmpty():
        links = stored(_balls(docs, todo, join), "links")
        labels = components(links)
        todo = _unfinished(todo.select("region", "doc"), labels)
    if not todo.isEmpty():
        todo = _unfinished(_lists(docs, todo.select(F.col("doc").alias("doc_id")).distinct(), join), labels)
    while not todo.isEmpty():
        todo = stored(todo.join(_main(todo), "region"), "regions")
        few, many = todo.where(f"outsiders <= {OUTSIDERS}"), todo.where(f"outsiders > {OUTSIDERS}")
        new = _by_outsiders(docs, few, join)
        parts = todo.where("1 = 0").select("region", "doc")
        if not many.isEmpty():
            pivot_links, parts, whole = _voronoi(docs, many.select("region", "doc", "size"), join)
            links, labels = _with_links(links, labels, new.union(pivot_links))
            whole = _unfinished(whole, labels)
            new = whole.where("1 = 0").select(F.col("doc").alias("a"), F.col("doc").alias("b")) if whole.isEmpty() else _joined_in_blocks(docs, whole, join)
        links, labels = _with_links(links, labels, new)
        todo = _unfinished(parts, labels)
    named = (thin.join(classes.select("h1", "h2", "rep"), ["h1", "h2"], "left")
             .withColumn("node", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("rep"))))
    return (named.join(labels, "node", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "node", "doc_id").alias("component_id")))
