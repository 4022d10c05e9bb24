"""N-gram Jaccard join in the metric space of shingle sets, exact at distance 1 - threshold.

Pivots divide the space into Voronoi regions, the triangle inequality says which documents near a border must be copied into
a region, and regions join recursively. Where documents serve as pivots and where not follows from the distances:

1. Sets of equal content are one point.
2. Unrelated texts are at distance 1 of each other, so no document tells them apart. There the pivots are single shingles, of
   which a set is near exactly those it holds; a fixed order picks the first n - ceil(threshold * n) + 1 of them, so that every pair
   within the bound meets (a prefix filter). In a region, pairs must lie in each other's window of sizes and of places. Regions
   that are too large are joined anew with their shingles last in the order, which spreads what only shares a passage.
3. What stays crowded holds texts that are near to each other. There the pivots are documents: every member's distance to some
   pivots is computed, members within the bound of a pivot are linked to it, and so to each other. A pair is open only if its ends
   are not connected so far. Ends that are outside the largest connected part of a region choose new pivots among them, round after
   round. What is left lies in the Voronoi region of its nearest pivot; members are copied into a region if the triangle
   inequality allows a link, and regions are joined in bounded blocks.

Links between different sets are confirmed on the words themselves.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import components, read, written

WORDS = 5
THRESHOLD = Fraction(3, 4)
#: Regions with more sets are joined recursively.
REGION = 32
#: Sets in a block of the last level; crowded regions with more open members take document pivots.
BLOCK = 1024
#: Document pivots of a region and round, and rounds at most; what is open then is joined in blocks.
PIVOTS, ROUNDS = 4, 4
#: Another round is worth while if the one before left at most this share of the open members.
PROGRESS = 0.8
#: Members that one task compares with a pivot.
SLICE = 4096
#: Shingles that are moved to the end of the order, the most crowded first (8 bytes each, broadcast).
DEMOTED = 1_000_000
#: Rows of (pivot, document) that are broadcast to fetch texts; more are joined by shuffling.
BROADCAST_ROWS = 500_000
#: Documents of a candidate component that are sent to one task; larger components are decided pair by pair.
TOGETHER = 512
#: Rows and shingles of a strip, and cells of the table it is multiplied with.
STRIP_ROWS, STRIP_SHINGLES, STRIP_CELLS = 128, 1 << 16, 1 << 22
#: Bytes of texts that are hashed at once, and of words that are hashed in lanes of eight; longer ones take blake2b.
SEGMENT, LANES = 1 << 21, 64
#: Shingles that are kept as words while links are confirmed, but for those of the pair itself.
HELD_SHINGLES = 1 << 15
#: Bits of the parity sketch: each differing shingle flips one, so differing bits bound the difference from below.
BITS = 1024

U = np.uint64
_SPACES = bytes([32, *range(9, 14)])
#: A-Z as a-z, white space as a blank.
_PLAIN = bytes(32 if c in _SPACES else c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORD = re.compile(rb"[^ ]+")
_STEP = 0x9E3779B97F4A7C15


def _mix(z: np.ndarray) -> np.ndarray:
    """A permutation of 64 bits without structure."""
    z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
    return z ^ (z >> U(31))


def _word_hashes(data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: eight bytes at a time pass through the mixer, so words of one length up to eight bytes never share a
    hash and no pattern in longer ones cancels out. Long words are hashed by a cryptographic function."""
    lanes = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), strides=(1,))
    size = end - begin
    out = _mix(size.astype(U) * U(_STEP))
    todo, at = np.flatnonzero(size <= LANES), 0
    while len(todo):
        left = size[todo] - at
        part = lanes[begin[todo] + at]
        cut = left < 8
        part[cut] &= (U(1) << (U(8) * left[cut].astype(U))) - U(1)
        out[todo] = _mix((out[todo] ^ part) + U(_STEP))
        todo, at = todo[left > 8], at + 8
    for i in np.flatnonzero(size > LANES).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[begin[i] : end[i]], digest_size=8).digest(), "little")
    return out


def word_shingles(text: str | None, words: int = WORDS) -> set[bytes]:
    """The shingles themselves, as words with blanks between."""
    w = _WORD.findall((text or "").encode().translate(_PLAIN))
    return {b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


class Confirmed:
    """Decides pairs of texts on their words; sets are kept while they hold few shingles together."""

    def __init__(self, texts: list[str | None]):
        self.texts, self.held, self.size = texts, {}, 0

    def shingles(self, i: int) -> set[bytes]:
        if i not in self.held:
            if self.size > HELD_SHINGLES:
                self.held.clear()
                self.size = 0
            self.held[i] = word_shingles(self.texts[i])
            self.size += len(self.held[i])
        return self.held[i]

    def __call__(self, i: int, j: int) -> bool:
        a, b = self.shingles(i), self.shingles(j)
        return bool(a) and bool(b) and bool(linked(len(a & b), len(a) + len(b)))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its word shingles; one hash for the whole of a shorter text."""
    raw = [(t or "").encode() for t in texts]
    if len(raw) > 1 and sum(map(len, raw)) > SEGMENT:
        half = len(raw) // 2
        return shingle_sets(texts[:half], words) + shingle_sets(texts[half:], words)
    data = b" ".join([*raw, b""]).translate(_PLAIN)
    if not data:
        return [np.zeros(0, U) for _ in texts]
    space = np.frombuffer(data, np.uint8) == 32
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
    begin, end = edge[::2], edge[1::2]
    word = _word_hashes(data, begin, end)
    bounds = np.cumsum([0, *(len(r) + 1 for r in raw)])
    first = np.searchsorted(begin, bounds)
    folded = _mix(word + U(words))
    for k in range(1, words):
        folded = _mix(folded[: len(folded) - 1] * U(_STEP) + word[k:]) if len(folded) > 1 else folded[:0]
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(folded[a : b - words + 1]))
        elif b > a:
            h = _mix(word[a : a + 1] + U(b - a))
            for k in range(a + 1, b):
                h = _mix(h * U(_STEP) + word[k : k + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, U))
    return out


def prefix_length(n: int, threshold: Fraction = THRESHOLD) -> int:
    return n - -(-n * threshold.numerator // threshold.denominator) + 1


def ordered(shingles: np.ndarray, demoted: np.ndarray) -> np.ndarray:
    """The set in the global order: by hash, demoted shingles last."""
    if not len(demoted):
        return shingles
    last = demoted[np.minimum(np.searchsorted(demoted, shingles), len(demoted) - 1)] == shingles
    return np.concatenate([shingles[~last], shingles[last]])


def sketch(shingles: np.ndarray) -> bytes:
    return np.packbits((np.bincount((shingles >> U(54)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).tobytes()


def common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0


def linked(both, sizes, threshold: Fraction = THRESHOLD):
    """Whether intersection >= threshold * union, in integers; ``sizes`` is the sum of both sizes."""
    return threshold.denominator * both >= threshold.numerator * (sizes - both)


def may_link(n: np.ndarray, place: np.ndarray, m: np.ndarray, other: np.ndarray, threshold: Fraction = THRESHOLD) -> np.ndarray:
    """Windows of sizes and of places (the region's shingle being the first common one)."""
    low, high = np.minimum(n, m), np.maximum(n, m)
    most = np.minimum(n - place, m - other)
    return (threshold.denominator * low >= threshold.numerator * high) & linked(most, n + m, threshold)


def texts_of(batch: pa.RecordBatch, step: int = 512) -> Iterator[tuple[int, list, list[np.ndarray]]]:
    """Slices of a batch whose first column is the id and second the text, with the shingle sets."""
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        yield at, part.column(0).to_pylist(), shingle_sets(part.column(1).to_pylist())


def regions(rows: DataFrame) -> DataFrame:
    """Joins each region of rows (s, x, n, place).

    Gives (a, b, kind): 0 for candidate pairs of small regions, 1 for (shingle, member) of large ones. A region is read
    as a stream: once it is known to be large its rows are handed on, so no task holds one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = [np.zeros(0, np.int64)] * 4
        crowded = None

        def closed(columns: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal rest, crowded
            s = columns[0]
            if not len(s):
                return
            starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(s)]]))
            size = np.repeat(sizes, sizes)
            index = np.arange(len(s)) - np.repeat(starts, sizes)
            open_ = np.zeros(len(s), bool)
            large = size > REGION
            if crowded is not None and s[0] == crowded:
                large[: sizes[0]] = True
            if not last:
                crowded = s[-1] if large[-1] else None
                if crowded is None:
                    open_[starts[-1] :] = True  # may go on in the next batch
            rest = [c[open_] for c in columns]
            if large.any():
                yield out(s[large], columns[1][large], 1)
            keep = ~large & ~open_ & (size > 1)
            if keep.any():
                x, n, place = (c[keep] for c in columns[1:])
                left = size[keep] - index[keep] - 1
                found = []
                for gap in range(1, REGION):
                    i = np.flatnonzero(left >= gap)
                    if not len(i):
                        break
                    i = i[may_link(n[i], place[i], n[i + gap], place[i + gap]) & (x[i] != x[i + gap])]
                    found.append(np.stack([np.minimum(x[i], x[i + gap]), np.maximum(x[i], x[i + gap])], axis=1))
                pairs = np.unique(np.concatenate(found), axis=0)
                if len(pairs):
                    yield out(pairs[:, 0], pairs[:, 1], 0)

        def out(a: np.ndarray, b: np.ndarray, kind: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(a), kind), pa.int32())], names=["a", "b", "kind"])

        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            yield from closed([np.concatenate(x) for x in zip(rest, new, strict=True)], False)
        yield from closed(rest, True)

    dealt = rows.select("s", "x", "n", "place").repartition("s").sortWithinPartitions("s", "x")
    return dealt.mapInArrow(run, "a long, b long, kind int")


def spread(sets: DataFrame) -> DataFrame:
    """(s, x, n, place) from (x, n, prefix)."""
    return sets.select("x", "n", F.posexplode("prefix").alias("place", "s")).select("s", "x", "n", "place")


class Join:
    """The steps of one join. ``docs`` has doc_id, unique where it is not null, and text."""

    def __init__(self, docs: DataFrame):
        self.spark = docs.sparkSession
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def points(self) -> DataFrame:
        """doc_id, n, fp (digest of the set) and sketch of every row."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, ids, sets in texts_of(batch):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(at, len(ids)), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([sketch(s) for s in sets], pa.binary())],
                        names=["doc_id", "n", "fp", "sketch"],
                    )

        return written(self.docs.mapInArrow(run, "doc_id long, n long, fp binary, sketch binary"), "jaccard-points")

    def prefixes(self, demoted: np.ndarray | None) -> DataFrame:
        """(x, n, prefix) per row; with ``demoted`` only of sets whose plain prefix holds one of those, in the new order."""
        shared = self.spark.sparkContext.broadcast(np.zeros(0, U) if demoted is None else demoted)
        every = demoted is None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low = shared.value
            for batch in batches:
                for _, ids, sets in texts_of(batch):
                    kept = [(i, s) for i, s in zip(ids, sets, strict=True) if i is not None and len(s)]
                    if not every:
                        kept = [(i, s) for i, s in kept if common(s[: prefix_length(len(s))], low)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i for i, _ in kept], pa.int64()), pa.array([len(s) for _, s in kept], pa.int64()), pa.array([ordered(s, low)[: prefix_length(len(s))].view(np.int64) for _, s in kept], pa.list_(pa.int64()))],
                        names=["x", "n", "prefix"],
                    )

        return self.docs.mapInArrow(run, "x long, n long, prefix array<long>")

    def fetched(self, wanted: DataFrame, key: str) -> DataFrame:
        """``wanted`` with the text of the document in column ``key``."""
        wanted = written(wanted, "jaccard-wanted")
        side = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
        return self.docs.join(side, F.col("doc_id") == F.col(key)).drop("doc_id")

    def verified(self, pairs: DataFrame, points: DataFrame) -> DataFrame:
        """Links that decide candidate pairs (a, b): the linked pairs themselves, or a forest that connects them."""
        bits = points.select("doc_id", "n", "sketch")
        near = pairs.join(bits.toDF("a", "na", "sa"), "a").join(bits.toDF("b", "nb", "sb"), "b").select("a", "b", "na", "nb", "sa", "sb")

        def by_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in (4, 5))
                apart = np.bitwise_count(left ^ right).sum(axis=1).astype(np.int64)
                size = batch.column(2).to_numpy() + batch.column(3).to_numpy()
                # |A| + |B| - 2 |A & B| >= apart
                keep = pa.array(linked((size - apart) // 2, size))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

        near = written(near.mapInArrow(by_sketch, "a long, b long").distinct(), "jaccard-pairs")
        # every link lies in a component of the candidates: a document's text goes to its component, once
        classes = components(near)
        classes = written(classes.select(F.col("component_id").alias("p"), F.col("id").alias("y")), "jaccard-components")
        sizes = classes.groupBy("p").count()
        small = classes.join(sizes.where(F.col("count") <= TOGETHER), "p").select("p", "y")
        rows = self.fetched(small, "y").select("p", "y", "text").repartition("p").sortWithinPartitions("p", "y")
        found = rows.mapInArrow(_components, "a long, b long")
        large = sizes.where(F.col("count") > TOGETHER)
        if large.isEmpty():
            return found
        rest = near.join(classes.join(large, "p").select(F.col("y").alias("a")), "a", "left_semi")
        return found.union(self.pair_by_pair(rest))

    def pair_by_pair(self, near: DataFrame) -> DataFrame:
        """The linked ones of pairs (a, b)."""
        return self.measured(near.select(F.col("a").alias("p"), F.col("b").alias("x"))).where("hit").select(F.col("p").alias("a"), F.col("x").alias("b"))

    def measured(self, pairs: DataFrame) -> DataFrame:
        """(p, x, d, hit) of distinct pairs (p, x): their distance, and whether they are linked. A pivot with many members is sent to
        as many tasks as these need; a task reads the pivot, then its members one after the other."""
        pairs = written(pairs.where("p <> x").distinct(), "jaccard-measured")
        shares = pairs.groupBy("p").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("shares"))
        members = pairs.join(shares, "p").select("p", F.pmod(F.xxhash64("x"), "shares").cast("int").alias("share"), "x")
        pivots = shares.select("p", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("p").alias("x"))
        rows = self.fetched(members.unionByName(pivots), "x").select("p", "share", "x", "text")
        rows = rows.repartition("p", "share").sortWithinPartitions("p", "share", F.col("x") != F.col("p"), "x")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivot, own, words = None, np.zeros(0, U), ""
            for batch in batches:
                found = []
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    texts = part.column(3).to_pylist()
                    for p, x, text, s in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), texts, shingle_sets(texts), strict=True):
                        if p == x:
                            pivot, own, words = p, s, text
                        elif p == pivot and len(s) and len(own):
                            both = common(own, s)
                            hit = bool(linked(both, len(own) + len(s))) and Confirmed([words, text])(0, 1)
                            found.append((p, x, 1 - both / (len(own) + len(s) - both), hit))
                columns = list(zip(*found, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.bool_()), strict=True)], names=["p", "x", "d", "hit"])

        return written(rows.mapInArrow(run, "p long, x long, d double, hit boolean"), "jaccard-distances")

    def pivoted(self, members: DataFrame) -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None, DataFrame | None]:
        """Rounds of document pivots over regions (s, x): (members with their part c, (pivots (s, p), distances (p, x, d)), edges).

        In each round every region with more than BLOCK open members chooses pivots among them, as documents with the smallest of
        several hashes, from the second round on half of them so and the two members that are most central by the distances known; its
        members are measured against the pivots of the first such region that they are in. Members are open if they are not of the largest
        connected part of their region."""
        labelled, measured, edges, chosen = members.withColumn("c", F.col("x")), None, None, None
        open_before = None
        for _ in range(ROUNDS):
            parts = labelled.groupBy("s", "c").count()
            tops = parts.groupBy("s").agg(F.max_by("c", F.struct("count", "c")).alias("top"), (F.sum("count") - F.max("count")).alias("open"))
            tops = written(tops.where(F.col("open") > BLOCK), "jaccard-open")
            still = tops.agg(F.sum("open")).first()[0] or 0
            if not still or open_before is not None and still > PROGRESS * open_before:
                break
            open_before = still
            inside = written(labelled.join(tops, "s").select("s", "x", (F.col("c") != F.col("top")).alias("free")), "jaccard-inside")
            picks = inside.where("free").groupBy("s").agg(F.array(*[F.min_by("x", F.xxhash64("x", F.lit(k))) for k in range(PIVOTS)]).alias("ps"))
            if measured is not None:
                # what lies near to the pivots so far is central, as the text that the others were made of
                middle = measured.groupBy("x").agg(F.avg("d").alias("mean"), F.max("d").alias("far"))
                central = inside.join(middle, "x").groupBy("s").agg(F.array(F.min_by("x", F.struct("mean", "x")), F.min_by("x", F.struct("far", "x"))).alias("cs"))
                picks = picks.join(central, "s", "left").select("s", F.concat(F.coalesce("cs", F.array().cast("array<bigint>")), F.slice("ps", 1, PIVOTS - PIVOTS // 2)).alias("ps"))
            picks = written(picks.select("s", F.explode(F.array_distinct("ps")).alias("p")), "jaccard-pivots")
            chosen = picks if chosen is None else chosen.unionByName(picks)
            # a member is measured against the pivots of one of its regions, not of each: regions of a group have much the same
            home = inside.groupBy("x").agg(F.min("s").alias("s"))
            new = self.measured(home.join(picks, "s").select("p", "x"))
            measured = new if measured is None else measured.unionByName(new)
            edges = measured.where("hit").select(F.col("p").alias("a"), F.col("x").alias("b"))
            classes = components(edges)
            labelled = members.join(classes, F.col("x") == F.col("id"), "left").select("s", "x", F.coalesce("component_id", "x").alias("c"))
            labelled = written(labelled, "jaccard-parts")
        return labelled, None if chosen is None else (chosen.distinct(), measured.groupBy("p", "x").agg(F.max("d").alias("d"))), edges

    def crowded(self, members: DataFrame, points: DataFrame) -> DataFrame:
        """Links inside regions that stayed large: (s, x) rows.

        A pair that shares several such regions is decided in the one with the smallest shingle. Open members are the core of the Voronoi
        region of their nearest pivot; into it come the members whose distance to that pivot the triangle inequality allows. A first
        pass over sizes, parts, distances and lists of regions finds the documents that a block needs, and only their texts are sent.
        """
        members = written(members.distinct(), "jaccard-crowded")
        labelled, pivots, edges = self.pivoted(members)
        lists = members.groupBy("x").agg(F.array_sort(F.collect_set("s")).alias("all"))
        sizes = points.groupBy(F.col("doc_id").alias("x")).agg(F.max("n").alias("n"))
        parts = labelled.groupBy("s", "c").count()
        tops = parts.groupBy("s").agg(F.max_by("c", F.struct("count", "c")).alias("top"), (F.sum("count") - F.max("count")).alias("left")).where("left > 0")
        rows = labelled.join(tops, "s").withColumn("open", F.col("c") != F.col("top")).drop("top")
        # what a member brings is joined before it is copied
        rows = rows.join(lists, "x").join(sizes, "x").withColumn("before", F.filter("all", lambda t: t < F.col("s"))).drop("all")
        none = F.array().cast("array<struct<p:bigint,d:double>>")
        if pivots is None:
            rows = rows.withColumns({"ds": none, "h": F.lit(0).cast("long")})
        else:
            chosen, measured = pivots
            near = measured.select("x", "p", "d").unionByName(chosen.select(F.col("p").alias("x"), "p", F.lit(0.0).alias("d")).distinct())
            near = near.groupBy("x").agg(F.collect_list(F.struct("p", "d")).alias("all_ds"))
            own = chosen.groupBy("s").agg(F.collect_set("p").alias("ps"))
            rows = rows.join(near, "x", "left").join(own, "s", "left")
            ds = F.array_sort(F.filter(F.coalesce("all_ds", none), lambda q: F.array_contains(F.coalesce("ps", F.array().cast("array<bigint>")), q["p"])))
            rows = rows.withColumn("ds", ds).drop("all_ds", "ps")
            # few open members need no regions of their own: the windows do
            home = F.when(F.col("left") > BLOCK, F.array_min(F.transform("ds", lambda q: F.struct(q["d"].alias("d"), q["p"].alias("p"))))["p"])
            rows = rows.withColumn("h", F.coalesce(home, F.lit(0).cast("long")))
        rows = written(rows.drop("left"), "jaccard-rows")
        to_cell = F.array_max(F.transform(F.filter("ds", lambda q: q["p"] == F.col("h")), lambda q: q["d"]))
        cells = rows.where("open").groupBy("s", "h").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"), F.max(to_cell).alias("far"), F.min(to_cell).alias("near"))
        bound, slack = 1 - float(THRESHOLD), 1e-9
        # visitors: members that a core member may be linked with, by their distance to the cell's pivot; where it is not known, nothing
        # is ruled out
        guests = rows.drop("h").join(cells, "s").withColumn("there", to_cell)
        apart = (F.col("there") > F.col("far") + bound + slack) | (F.col("there") < F.col("near") - bound - slack)
        guests = guests.where(~F.coalesce(apart, F.lit(False))).drop("there")
        counted = guests.groupBy("s", "h").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nv"))
        spread_over = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        core = rows.where("open").join(cells.select("s", "h", "nb"), ["s", "h"]).join(counted, ["s", "h"])
        core = core.withColumn("i", F.pmod(F.xxhash64("x"), "nb").cast("int")).withColumn("j", spread_over("nv")).withColumn("core", F.lit(True))
        guests = guests.join(counted, ["s", "h"]).withColumn("j", F.pmod(F.xxhash64("x"), "nv").cast("int")).withColumn("i", spread_over("nb")).withColumn("core", F.lit(False))
        columns = ["s", "h", "i", "j", "core", "x", "c", "open", "ds", "n", "before"]
        tasks = core.select(*columns).unionByName(guests.select(*columns))

        def needed(key, table):
            x, n, part = (table.column(c).to_numpy() for c in ("x", "n", "c"))
            is_core, free = (table.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("core", "open"))
            columns: dict[int, int] = {}
            flat = [(i, columns.setdefault(t, len(columns))) for i, m in enumerate(table.column("before").to_pylist()) for t in m]
            grid = np.zeros((len(x), max(1, len(columns))), np.float32)
            if flat:
                grid[tuple(np.array(flat).T)] = 1
            spots = table.column("ds").to_pylist()
            pivots = sorted({q["p"] for ds in spots for q in ds})
            gaps = np.full((len(x), len(pivots)), np.nan)
            for i, ds in enumerate(spots):
                for q in ds:
                    gaps[i, pivots.index(q["p"])] = q["d"]
            left, right = np.flatnonzero(is_core), np.flatnonzero(~is_core)
            use = np.zeros(len(x), bool)
            for at in range(0, len(left), 256):
                q = left[at : at + 256]
                ok = (grid[q] @ grid[right].T == 0) & (THRESHOLD.denominator * n[q][:, None] >= THRESHOLD.numerator * n[right][None]) & (THRESHOLD.denominator * n[right][None] >= THRESHOLD.numerator * n[q][:, None])
                # a pair of open members meets in both ends' regions
                ok &= (part[q][:, None] != part[right][None]) & (~free[right][None] | (x[q][:, None] < x[right][None]))
                for k in range(len(pivots)):
                    ok &= ~(np.abs(gaps[q, k][:, None] - gaps[right, k][None]) > bound + slack)
                use[q] |= ok.any(axis=1)
                use[right] |= ok.any(axis=0)
            picked = np.flatnonzero(use)
            task = ":".join(str(k.as_py()) for k in key)
            return pa.table({"task": pa.array([task] * len(picked), pa.string()), "core": pa.array(is_core[picked]), "x": pa.array(x[picked], pa.int64()), "c": pa.array(part[picked], pa.int64())})

        # dealt by block: by region alone, all blocks of a crowded one would meet in one task
        wanted = tasks.repartition("s", "h", "i", "j").groupBy("s", "h", "i", "j").applyInArrow(needed, "task string, core boolean, x long, c long")
        wanted = wanted.groupBy("task", "x").agg(F.max("core").alias("core"), F.min("core").alias("only"), F.min("c").alias("c"))
        sent = self.fetched(wanted, "x").select("task", "core", "only", "x", "c", "text")

        def decide(table):
            x, part = table.column("x").to_numpy(), table.column("c").to_numpy()
            texts = table.column("text").to_pylist()
            left, only = (table.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("core", "only"))
            edges = block_links(shingle_sets(texts), left, ~only, parts=np.unique(part, return_inverse=True)[1], confirm=Confirmed(texts))
            return pa.table({"a": pa.array([int(x[i]) for i, _ in edges], pa.int64()), "b": pa.array([int(x[j]) for _, j in edges], pa.int64())})

        found = sent.groupBy("task").applyInArrow(decide, "a long, b long")
        return found if edges is None else found.unionByName(edges)

    def links(self, points: DataFrame, reps: DataFrame) -> DataFrame:
        """Edges (a, b) between representatives of equal sets that connect all that is linked."""
        # copies are left out: by their ids where these are few enough to send, else by a join
        known = points.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "fp").join(reps, "fp")
        copies = known.where("doc_id <> rep").select(F.col("doc_id").alias("x")).distinct()
        copies = written(copies.join(reps, F.col("x") == F.col("rep"), "left_anti"), "jaccard-copies")
        copies = F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies.hint("merge")
        first = written(regions(spread(self.prefixes(None).join(copies, "x", "left_anti"))), "jaccard-regions")
        pairs = first.where("kind = 0")
        crowds = first.where("kind = 1").groupBy("a").count()
        large = written(crowds.orderBy(F.desc("count"), "a").limit(DEMOTED).select("a"), "jaccard-demoted")
        demoted = np.sort(np.array([r.a for r in large.toLocalIterator()], np.int64).view(U))
        found = None
        if len(demoted):
            second = written(regions(spread(self.prefixes(demoted).join(copies, "x", "left_anti"))), "jaccard-regions")
            pairs = pairs.union(second.where("kind = 0"))
            members = second.where("kind = 1").select(F.col("a").alias("s"), F.col("b").alias("x"))
            if len(demoted) == DEMOTED:
                # large regions beyond the bound keep their place in the order and are joined in blocks as they are
                members = members.union(first.where("kind = 1").join(large, "a", "left_anti").select("a", "b"))
            found = self.crowded(members, points)
        checked = self.verified(pairs.select("a", "b").distinct(), points.where("doc_id IS NOT NULL"))
        return checked if found is None else checked.union(found)


def _components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forests of the links inside groups of rows (group, id, text) that stand together."""
    key, ids, sets, texts = None, [], [], []

    def decided() -> pa.RecordBatch:
        every = np.ones(len(ids), bool)
        edges = [(ids[i], ids[j]) for i, j in block_links(sets, every, every, confirm=Confirmed(texts))]
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            new = part.column(2).to_pylist()
            for p, y, s, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), shingle_sets(new), new, strict=True):
                if p != key:
                    if len(ids) > 1:
                        yield decided()
                    key, ids, sets, texts = p, [], [], []
                ids.append(y)
                sets.append(s)
                texts.append(text)
    if len(ids) > 1:
        yield decided()


def block_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: Fraction = THRESHOLD, parts: np.ndarray | None = None, confirm: Callable[[int, int], bool] = lambda i, j: True) -> list[tuple[int, int]]:
    """Linked pairs (row of left, row of right) that connect all that is linked, decided exactly. Rows of one of ``parts`` are known to be
    connected. ``confirm`` has the last word on a pair.

    The first row is the pivot. Rows are sorted by their distance to it, and by the triangle inequality only pairs whose
    distances differ by at most the bound are computed, strip by strip, as products of incidence rows.
    """
    if not len(sets):
        return []
    size = np.array([len(s) for s in sets])
    part = np.arange(len(sets)) if parts is None else parts.copy()
    edges: list[tuple[int, int]] = []

    def join_ends(i: int, j: int) -> None:
        if part[i] != part[j] and confirm(i, j):
            edges.append((i, j))
            part[part == part[j]] = part[i]

    if len(sets) <= 6:
        for i in np.flatnonzero(left).tolist():
            for j in np.flatnonzero(right).tolist():
                if i != j and (both := common(sets[i], sets[j])) and linked(both, int(size[i] + size[j]), threshold):
                    join_ends(i, j)
        return edges
    to_pivot = np.array([1 - (c := common(sets[0], s)) / max(1, len(sets[0]) + len(s) - c) for s in sets])
    bound = 1 - float(threshold) + 1e-9
    shingle, column = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(column) > 1
    number = np.cumsum(often) - 1
    row = np.repeat(np.arange(len(sets)), size)
    keep = often[column]
    row, column = row[keep], number[column[keep]]
    starts = np.searchsorted(row, np.arange(len(sets) + 1))
    order_l = np.flatnonzero(left)[np.argsort(to_pivot[left], kind="stable")]
    order_r = np.flatnonzero(right)[np.argsort(to_pivot[right], kind="stable")]
    at = 0
    while at < len(order_l):
        # a strip holds a bounded number of shingles, so its table is small however long the texts are
        held = np.cumsum(size[order_l[at : at + STRIP_ROWS]])
        rows = max(1, int(np.searchsorted(held, STRIP_SHINGLES, "right")))
        q, at = order_l[at : at + rows], at + rows
        lo = np.searchsorted(to_pivot[order_r], to_pivot[q[0]] - bound, "left")
        window = order_r[lo : np.searchsorted(to_pivot[order_r], to_pivot[q[-1]] + bound, "right")]
        used = np.unique(np.concatenate([column[starts[i] : starts[i + 1]] for i in q]))
        if not len(used):
            continue
        place = np.full(int(often.sum()), -1)
        place[used] = np.arange(len(used))
        table = np.zeros((len(q), len(used)), np.float32)
        for k, i in enumerate(q):
            table[k, place[column[starts[i] : starts[i + 1]]]] = 1
        wide = max(1, STRIP_CELLS // len(used))
        for w in range(0, len(window), wide):
            r = window[w : w + wide]
            grid = np.zeros((len(r), len(used)), np.float32)
            for k, i in enumerate(r):
                spots = place[column[starts[i] : starts[i + 1]]]
                grid[k, spots[spots >= 0]] = 1
            both = (table @ grid.T).astype(np.int64)
            hit = linked(both, size[q][:, None] + size[r][None], threshold) & (q[:, None] != r[None]) & (both > 0)
            for k in np.flatnonzero(hit.any(axis=1)):
                for j in r[hit[k]]:
                    join_ends(int(q[k]), int(j))
    return edges


def keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``docs`` with a key ``_x`` that is unique but for rows of one id and text, and whether it is other than doc_id.

    Where ids repeat, the rows of those ids have a 64-bit hash of id and text for a key. Rows without an id have no key.
    """
    docs = docs.withColumn("_x", F.col("doc_id").cast("long"))
    again = docs.where("_x IS NOT NULL").groupBy(F.col("_x").alias("_r")).count().where("count > 1").select("_r")
    if again.isEmpty():
        return docs, False
    own = F.when(F.col("_r").isNotNull(), F.xxhash64("_x", F.coalesce("text", F.lit("")))).otherwise(F.col("_x"))
    return docs.join(again, F.col("_x") == F.col("_r"), "left").withColumn("_x", own).drop("_r"), True


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points (doc_id, n, fp) of rows whose doc_id is a key, and the class (fp, component_id) of every set: a key of it."""
    work = Join(docs)
    points = work.points()
    known = points.where("n > 0 AND doc_id IS NOT NULL")
    reps = written(known.groupBy("fp").agg(F.min("doc_id").alias("rep")), "jaccard-classes")
    found = components(work.links(points, reps))
    named = reps.join(found, F.col("rep") == F.col("id"), "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    return points, named


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``.

    Null and empty texts and texts without words have no shingles and link with nothing. Texts with the same set are
    linked. Rows that repeat an id are one document that has the links of all its texts; a null id stays unlinked and
    has a null class. Other columns are not read.
    """
    rows, repeated = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    if not repeated:
        points, named = classes(rows.select(F.col("_x").alias("doc_id"), "text"))
        out = points.select("doc_id", "n", F.when(F.col("n") > 0, F.col("fp")).alias("fp")).join(named, "fp", "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    ids = written(rows.select("doc_id", "_x"), "jaccard-ids")
    points, named = classes(_once(rows))
    found = points.select(F.col("doc_id").alias("x"), "n", F.when(F.col("n") > 0, F.col("fp")).alias("fp")).join(named, "fp", "left")
    found = written(found.select("x", "n", F.coalesce("component_id", "x").alias("c")), "jaccard-found")
    # an id connects the classes of its texts
    of_id = ids.join(found, F.col("_x") == F.col("x")).select("doc_id", "c").distinct()
    ends = of_id.groupBy("doc_id").agg(F.min("c").alias("a"))
    joined = components(of_id.join(ends, "doc_id").select("a", F.col("c").alias("b")))
    least = of_id.join(joined, F.col("c") == F.col("id")).groupBy(F.col("component_id").alias("k")).agg(F.min("doc_id").alias("least"))
    label = joined.join(least, F.col("component_id") == F.col("k")).select(F.col("id").alias("c"), "least")
    labelled = ids.join(found, F.col("_x") == F.col("x")).join(label, "c").select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))
    return labelled.unionByName(found.where("x IS NULL").select(F.col("x").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("x").alias("component_id")))


def _once(rows: DataFrame) -> DataFrame:
    """(doc_id, text) of ``keyed`` rows, the key for the id, each key once."""
    plain = rows.select(F.col("_x").alias("doc_id"), "text")
    return plain.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(plain.where("doc_id IS NULL"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of linked texts: of the smallest key (see ``keyed``), the smallest id where ids do not repeat.

    Every text counts by itself: rows that repeat an id are linked only if their texts are, and of rows with one id and one text one stays.
    Rows without an id and without words stay.
    """
    rows, repeated = keyed(docs)
    points, named = classes(_once(rows) if repeated else rows.select(F.col("_x").alias("doc_id"), "text"))
    others = points.where("n > 0").join(named, "fp").where("component_id <> doc_id").select(F.col("doc_id").alias("_x")).distinct()
    kept = rows.join(others, "_x", "left_anti")
    if repeated:
        kept = kept.where("_x IS NOT NULL").dropDuplicates(["_x"]).unionByName(kept.where("_x IS NULL"))
    return kept.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.c) AS component_id FROM n JOIN r ON r.id = n.doc_id GROUP BY n.doc_id, n.n
"""

QUERIES = {"op7_jaccard_join": query}
ORACLE_SQL = {"op7_jaccard_join": SQL}
