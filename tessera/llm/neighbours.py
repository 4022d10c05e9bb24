"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees.

Vectors on the unit sphere with cosine >= c lie at a distance of at most sqrt(2 - 2c). The upper levels of the tree are
centers of a bounded sample, which every task knows; their vectors form leaves, and leaves blocks of bounded size. In a
block the tree goes on with nets of halving radii, down to nodes so small that their members are all linked. From there on a
node stands for its members: center, covering radius and number are what is compared. A node is sent to another leaf only
if center and radius say that a link is possible there. A pair of nodes is dropped if even its closest members are too far
apart, taken whole if even its farthest members are near enough, and split otherwise; members meet only where the bounds of
two smallest nodes leave it open.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import components, read, written

#: Vectors or nodes in a block, on average at most.
BLOCK = 8192
#: Centers of the first level, and centers below each of them, at most; and bytes of all of them together.
PIVOTS, CENTERS_BYTES = 256, 1 << 25
#: Halving radii of the levels below a block, down to a third of the limit of the usual threshold. Coarser ones would rule nothing out.
RADII = (0.5, 0.25, 0.125)
#: Members of an open pair of nodes that one task reads.
SLICE = 1 << 14
#: Pairs of nodes with at most so many pairs of members are computed without going further down.
SMALL = 1 << 18
#: Allowance for single precision, in which only candidates are sought.
ROUGH = 1e-5
#: Bounds are only trusted beyond rounding errors; what lies nearer is computed.
SLACK = 1e-9
#: Rows of a distance table that is held at once.
STEP = 512


def unit_rows(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(usable, unit vectors of the usable ones) in double precision. Null, empty and zero vectors and those with null or
    non-finite components are not usable."""
    rows = values.to_pylist() if values.null_count or values.type.value_type == pa.null() else None
    sizes = values.value_lengths().to_numpy(zero_copy_only=False) if rows is None else None
    if rows is None and len(sizes) and (sizes == sizes[0]).all() and values.flatten().null_count == 0 and sizes[0]:
        matrix = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)
    else:
        rows = rows if rows is not None else values.to_pylist()
        width = max((len(r) for r in rows if r), default=1)
        matrix = np.full((len(rows), width), np.nan)
        for i, r in enumerate(rows):
            if r and None not in r:
                matrix[i] = 0
                matrix[i, : len(r)] = r
    with np.errstate(over="ignore", invalid="ignore"):
        peak = np.abs(matrix).max(axis=1, initial=0)
        usable = np.isfinite(matrix).all(axis=1) & (peak > 0)
        # by a power of two, which loses nothing
        scaled = np.ldexp(matrix[usable], -np.frexp(peak[usable])[1][:, None])
        return usable, scaled / np.sqrt(np.einsum("nd,nd->n", scaled, scaled))[:, None]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def net(rows: np.ndarray, members: np.ndarray, radius: float) -> list[np.ndarray]:
    """Greedy net in the members' order: groups that begin with their center, all within the radius of it. The first
    member is the first center, so a level's centers are centers of the next level too."""
    near = 1 - radius * radius / 2
    heads: list[int] = []
    owner = np.empty(len(members), int)
    for at in range(0, len(members), STEP):
        part = members[at : at + STEP]
        best, who = np.full(len(part), -2.0), np.zeros(len(part), int)
        if heads:
            cosines = rows[part] @ rows[np.array(heads)].T
            who, best = cosines.argmax(axis=1), cosines.max(axis=1)
        open_ = np.flatnonzero(best < near)
        if len(open_):
            inner = rows[part[open_]] @ rows[part[open_]].T
            crowd = (inner >= near).sum(axis=1) > 1
            for i, k in enumerate(open_):
                if best[k] < near:
                    if crowd[i]:
                        mine = inner[i] > best[open_]
                        best[open_[mine]] = inner[i][mine]
                        who[open_[mine]] = len(heads)
                    best[k], who[k] = np.inf, len(heads)
                    heads.append(int(part[k]))
        owner[at : at + len(part)] = who
    order = np.lexsort((members != np.array(heads)[owner], owner))
    return np.split(members[order], np.flatnonzero(np.diff(owner[order])) + 1)


def planted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A cover tree over unit vectors, as an order of the rows and the coarsest level at which each begins a node.

    Nodes of a level are runs of rows that begin with their center; nodes of the next level divide them.
    """
    order = np.arange(len(rows))
    level = np.full(len(rows), len(RADII) + 1)
    level[:1] = 0
    runs = [(0, len(rows))]
    for number, radius in enumerate(RADII, 1):
        below = []
        for start, end in runs:
            groups = net(rows, order[start:end], radius)
            order[start:end] = np.concatenate(groups)
            for g in groups:
                level[start] = min(level[start], number)
                if len(g) > 1:
                    below.append((start, start + len(g)))
                start += len(g)
        runs = below
    # rows alone in a node begin every finer node too
    return order, level


class Tree:
    """Rows in tree order, and per level the nodes' starts, ends and covering radii (largest distances to the center).

    A row may stand for ``weight`` vectors within ``reach`` of it; radii cover these as well."""

    def __init__(self, rows: np.ndarray, level: np.ndarray, reach: np.ndarray | None = None, weight: np.ndarray | None = None):
        self.rows = rows
        self.reach = np.zeros(len(rows)) if reach is None else reach
        self.weight = np.ones(len(rows), np.int64) if weight is None else weight
        self.starts, self.ends, self.radius = [], [], []
        for number in range(len(RADII) + 1):
            starts = np.flatnonzero(level <= number)
            if not len(rows):
                starts = np.zeros(0, int)
            ends = np.append(starts[1:], len(rows)) if len(starts) else starts
            gaps = self.reach.copy()
            many = np.flatnonzero(np.repeat(ends - starts, ends - starts) > 1)
            center = np.repeat(starts, ends - starts)[many]
            gaps[many] += np.sqrt(np.maximum(2 - 2 * np.einsum("nd,nd->n", rows[many], rows[center]), 0))
            self.starts.append(starts)
            self.ends.append(ends)
            self.radius.append(np.maximum.reduceat(gaps, starts) if len(starts) else gaps)

    def kids(self, level: int, node: int) -> range:
        """The next level's nodes below a node."""
        lo, hi = np.searchsorted(self.starts[level + 1], [self.starts[level][node], self.ends[level][node]])
        return range(int(lo), int(hi))


def join(a: Tree, b: Tree, limit: float, same: bool, near: float | None = None) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]], list[tuple[int, int]]]:
    """Dual traversal: numbers of vectors linked with every row of ``a`` and of ``b``, a spanning forest of the linked rows as edges
    (row of a, row of b), and the pairs of rows that stay open, as their reach does not decide them.

    With ``same`` the trees are one: each pair counts once for both ends and no row is its own link. ``near`` is the cosine of the limit.
    """
    links_a, links_b = np.zeros(len(a.rows), np.int64), np.zeros(len(b.rows), np.int64)
    edges: list[tuple[int, int]] = []
    open_pairs: list[tuple[int, int]] = []
    near = 1 - limit * limit / 2 if near is None else near
    # parts found connected so far; a row of b is numbered behind those of a
    shift = 0 if same else len(a.rows)
    part = np.arange(len(a.rows) + (0 if same else len(b.rows)))

    def connect(left: np.ndarray, right: np.ndarray) -> None:
        """All of ``left`` are linked with all of ``right``: keep an edge for each part that this adds."""
        ends = np.concatenate([left, right + shift])
        parts, first = np.unique(part[ends], return_index=True)
        if len(parts) > 1:
            for k in first.tolist():
                edges.append((int(left[k]), int(right[0])) if k < len(left) else (int(left[0]), int(right[k - len(left)])))
            part[np.isin(part, parts)] = parts[0]

    def whole(s: tuple[int, int], t: tuple[int, int]) -> None:
        links_a[s[0] : s[1]] += b.weight[t[0] : t[1]].sum()
        links_b[t[0] : t[1]] += a.weight[s[0] : s[1]].sum()
        connect(np.arange(*s), np.arange(*t))

    def table(s: tuple[int, int], t: tuple[int, int], own: bool) -> None:
        for at in range(s[0], s[1], STEP):
            end = min(at + STEP, s[1])
            cosines = a.rows[at:end] @ b.rows[t[0] : t[1]].T
            reach = a.reach[at:end][:, None] + b.reach[t[0] : t[1]][None]
            hit = cosines >= near
            if reach.any():
                gap = np.sqrt(np.maximum(2 - 2 * cosines, 0))
                wide = reach > 0
                maybe = wide & (gap - reach <= limit + SLACK)
                hit = np.where(wide, gap + reach <= limit - SLACK, hit)
                maybe &= ~hit
                if own:
                    maybe &= np.arange(at, end)[:, None] < np.arange(t[0], t[1])[None]
                open_pairs.extend((at + int(i), t[0] + int(j)) for i, j in zip(*np.nonzero(maybe), strict=True))
            if own:
                hit[np.arange(len(hit)), np.arange(len(hit)) + at - s[0]] = False
            links_a[at:end] += hit @ b.weight[t[0] : t[1]]
            if not own:
                links_b[t[0] : t[1]] += a.weight[at:end] @ hit
            for i in np.flatnonzero(hit.any(axis=1)):
                connect(np.array([at + i]), t[0] + np.flatnonzero(hit[i]))

    todo: list[tuple[int, int, int, bool]] = [(0, 0, 0, same)] if len(a.rows) and len(b.rows) else []
    while todo:
        level, p, q, own = todo.pop()
        s, t = (a.starts[level][p], a.ends[level][p]), (b.starts[level][q], b.ends[level][q])
        members = (s[1] - s[0]) * (t[1] - t[0])
        if own and 2 * a.radius[level][p] <= limit - SLACK:
            if s[1] - s[0] > 1:
                links_a[s[0] : s[1]] += a.weight[s[0] : s[1]].sum() - a.weight[s[0] : s[1]]
                connect(np.arange(s[0], s[0] + 1), np.arange(s[0] + 1, s[1]))
            continue
        if level == len(RADII) or level and members <= SMALL:
            table(s, t, own)
            continue
        left, right = a.kids(level, p), b.kids(level, q)
        if own:
            sizes = a.ends[level + 1][left] - a.starts[level + 1][left]
            todo += [(level + 1, left[k], left[k], True) for k in np.flatnonzero(sizes > 1).tolist()]
        for i, j in near_nodes(a, left, b, right, level + 1, limit, own):
            gap = distances(a.rows[a.starts[level + 1][i]][None], b.rows[b.starts[level + 1][j]][None])[0, 0]
            reach = a.radius[level + 1][i] + b.radius[level + 1][j]
            if gap - reach > limit + SLACK:
                continue
            if gap + reach <= limit - SLACK:
                whole((a.starts[level + 1][i], a.ends[level + 1][i]), (b.starts[level + 1][j], b.ends[level + 1][j]))
            else:
                todo.append((level + 1, i, j, False))
    if same:
        return links_a + links_b, links_a + links_b, edges, open_pairs
    return links_a, links_b, edges, open_pairs


def near_nodes(a: Tree, left: range, b: Tree, right: range, level: int, limit: float, upper: bool) -> Iterator[tuple[int, int]]:
    """Pairs of nodes that single precision and the largest radius on the right cannot rule out."""
    if not len(left) or not len(right):
        return
    others = b.rows[b.starts[level][right]].astype(np.float32)
    most = limit + float(b.radius[level][right].max()) + ROUGH
    for at in range(0, len(left), STEP):
        part = np.arange(left[0] + at, left[0] + min(at + STEP, len(left)))
        reach = np.minimum(most + a.radius[level][part], 2.0)
        keep = a.rows[a.starts[level][part]].astype(np.float32) @ others.T >= (1 - reach * reach / 2 - ROUGH).astype(np.float32)[:, None]
        i, j = np.divmod(np.flatnonzero(keep), len(right))
        i, j = part[i], right[0] + j
        if upper:
            i, j = i[i < j], j[i < j]
        yield from zip(i.tolist(), j.tolist(), strict=True)


class Leaves:
    """The upper levels: centers, the centers below each, and what a vector is near to. Small enough to be sent with a function."""

    def __init__(self, tops: np.ndarray, below: dict[int, np.ndarray]):
        self.tops, self.below = tops, below
        counts = [len(below.get(c, ())) or 1 for c in range(len(tops))]
        self.first = np.cumsum([0, *counts])
        self.radius, self.top_radius = np.zeros(self.first[-1]), np.zeros(len(tops))

    def centers(self, top: int) -> np.ndarray:
        return self.below[top] if top in self.below else self.tops[top : top + 1]

    def place(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(leaf, distance to its center, top, distance to it) of unit vectors: the nearest top and the nearest center below it."""
        gaps = distances(rows, self.tops)
        top = gaps.argmin(axis=1)
        leaf, gap = np.zeros(len(rows), np.int64), np.zeros(len(rows))
        for c in np.unique(top):
            mine = np.flatnonzero(top == c)
            inner = distances(rows[mine], self.centers(c))
            leaf[mine], gap[mine] = self.first[c] + inner.argmin(axis=1), inner.min(axis=1)
        return leaf, gap, top, gaps[np.arange(len(rows)), top]

    def visits(self, rows: np.ndarray, reach: np.ndarray, leaf: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for the other leaves that may hold a link of a vector within ``reach`` of a row; of two leaves one visits the other.

        A link's end lies within a leaf's covering radius of its center, and no farther from it than from the other centers that it had the
        choice of."""
        gaps = distances(rows, self.tops)
        lowest = gaps.min(axis=1)
        more = limit + SLACK
        found_rows, found_leaves = [], []
        for c in range(len(self.tops)):
            near = np.flatnonzero((gaps[:, c] - reach <= self.top_radius[c] + more) & (gaps[:, c] - reach <= lowest + reach + 2 * more))
            if not len(near):
                continue
            inner = distances(rows[near], self.centers(c))
            numbers = np.arange(self.first[c], self.first[c + 1])
            ok = (inner - reach[near, None] <= self.radius[numbers][None] + more) & (inner - reach[near, None] <= inner.min(axis=1, keepdims=True) + reach[near, None] + 2 * more)
            here = leaf[near, None]
            ok &= (here != numbers[None]) & ((here < numbers[None]) ^ ((here + numbers[None]) % 2 == 1))
            i, j = np.nonzero(ok)
            found_rows.append(near[i])
            found_leaves.append(numbers[j])
        if not found_rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found_rows), np.concatenate(found_leaves)


def _leaves(good: DataFrame, count: int, width: int) -> tuple[Leaves, DataFrame]:
    """The upper levels over vectors (vec_id, v), and the vectors with their leaf, written.

    Both samples are bounded: vectors with the smallest hashes, one for each BLOCK vectors, PIVOTS at most, and as many in each top."""
    tops = pad([r.v for r in good.orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v").limit(min(PIVOTS, -(-count // BLOCK))).select("v").collect()], width)
    plain = Leaves(tops, {})

    def near_top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pad(batch.column("v").to_pylist(), width)
            top = plain.place(rows)[2] if len(rows) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(top, pa.int32())], names=["vec_id", "v", "top"])

    topped = good.select("vec_id", "v").mapInArrow(near_top, "vec_id long, v binary, top int")
    below: dict[int, np.ndarray] = {}
    sizes = {r.top: r["count"] for r in topped.groupBy("top").count().collect()} if count > BLOCK else {}
    most = max(1, CENTERS_BYTES // max(8, width))
    wanted = {c: min(PIVOTS, -(-n // BLOCK), max(1, most * n // count)) for c, n in sizes.items() if n > BLOCK}
    wanted = {c: k for c, k in wanted.items() if k > 1}
    if wanted:
        spark = good.sparkSession
        shares = spark.createDataFrame([(int(c), int(k)) for c, k in wanted.items()], "top int, k int")
        picked = topped.join(F.broadcast(shares), "top").groupBy("top", F.pmod(F.xxhash64("v", "vec_id"), "k").alias("slot")).agg(F.min_by("v", F.xxhash64("vec_id", "v")).alias("v"))
        rows: dict[int, list[bytes]] = {}
        for r in picked.orderBy("top", "slot").collect():
            rows.setdefault(r.top, []).append(r.v)
        below = {c: pad(v, width) for c, v in rows.items()}
    leaves = Leaves(tops, below)

    def near_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pad(batch.column("v").to_pylist(), width)
            leaf, gap, top, far = leaves.place(rows) if len(rows) else (np.zeros(0, int), np.zeros(0), np.zeros(0, int), np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(leaf, pa.int64()), pa.array(gap), pa.array(top, pa.int32()), pa.array(far)], names=["vec_id", "v", "leaf", "gap", "top", "far"])

    placed = written(good.select("vec_id", "v").mapInArrow(near_leaf, "vec_id long, v binary, leaf long, gap double, top int, far double"), "vector-leaves")
    for r in placed.groupBy("leaf", "top").agg(F.max("gap").alias("gap"), F.max("far").alias("far")).collect():
        leaves.radius[r.leaf] = r.gap
        leaves.top_radius[r.top] = max(leaves.top_radius[r.top], r.far)
    return leaves, placed.select("vec_id", "v", "leaf")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row with an id.

    ``embedding`` is an array of numbers. Vectors that are null, empty or zero, or hold null or non-finite components,
    link with nothing. Shorter vectors count as padded with zeros. Rows that repeat an id with a usable vector each are
    vectors of their own for linking and are returned once per row with the id's class; a null id is returned unlinked.
    Other columns are not read. Numbers of links and a spanning forest leave each comparison, never the pairs of a group. A
    group of vectors that are all linked is compared as the few nodes it falls into, however large it is.
    """
    limit = math.sqrt(2 - 2 * threshold)
    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))

    def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, unit = unit_rows(batch.column(1))
            # -0.0 and padding would tell equal vectors apart: only the bytes of plain zeros are kept
            rows = [r.tobytes() for r in unit + 0.0]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), pa.array(rows, pa.binary())], names=["vec_id", "v"])

    good = written(slim.where("vec_id IS NOT NULL").mapInArrow(usable, "vec_id long, v binary"), "vectors")
    count, width = good.agg(F.count("*"), F.max(F.octet_length("v"))).first()
    if not count:
        return slim.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    leaves, placed = _leaves(good, count, width)
    # a third of a smaller limit than the usual one lies below the last level: then only equal vectors share a node
    finest = RADII[-1] if 2 * RADII[-1] <= limit - SLACK else 0.0

    def plant(table):
        """A block's tree, and the nodes of its last level: every member with its node, the center first."""
        table = table.sort_by([("vec_id", "ascending"), ("v", "ascending")])
        rows = pad(table.column("v").to_pylist(), width)
        order, level = planted(rows)
        rows = rows[order]
        starts = np.flatnonzero(level <= len(RADII)) if finest else np.arange(len(rows))
        sizes = np.diff(np.append(starts, len(rows)))
        center = np.repeat(starts, sizes)
        gaps = np.where(center == np.arange(len(rows)), 0, distances_of(rows, rows[center]))
        ids = table.column("vec_id").to_numpy()[order]
        block = table.column("block").to_numpy()[0]
        node = (table.column("leaf").to_numpy()[0] << 40) + (block << 20) + np.repeat(np.arange(len(starts)), sizes)
        return pa.table({
            "node": pa.array(node, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "v": table.column("v").take(pa.array(order)), "head": pa.array(ids[center], pa.int64()),
            "n": pa.array(np.repeat(sizes, sizes), pa.int64()), "reach": pa.array(np.repeat(np.maximum.reduceat(gaps, starts), sizes)), "first": pa.array(center == np.arange(len(rows))),
        })

    blocks = placed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("nb"))
    dealt = placed.join(F.broadcast(blocks), "leaf").withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), "nb"))
    members = dealt.select("leaf", "block", "vec_id", "v").groupBy("leaf", "block").applyInArrow(plant, "node long, vec_id long, v binary, head long, n long, reach double, first boolean")
    members = written(members, "vector-members")
    nodes = members.where("first").select("node", "head", "v", "n", "reach", F.shiftright("node", 40).alias("leaf"))
    found = written(_compared(nodes, leaves, limit, threshold, width), "vector-links")
    opened = written(found.where("open").select("a", "b"), "vector-open")
    inner = _members_compared(members, opened, threshold, width)
    inner = None if opened.isEmpty() else written(inner, "vector-inner")
    # links of a vector: its node's other members, what its node is linked with whole, and what it is linked with itself
    of_node = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("more"))
    links = members.select("node", "vec_id", (F.col("n") - 1).alias("own")).join(of_node, "node", "left").select(F.col("vec_id").alias("a"), (F.col("own") + F.coalesce("more", F.lit(0))).alias("n"))
    edges = members.where("vec_id <> head").select(F.col("head").alias("a"), F.col("vec_id").alias("b"))
    heads = nodes.select("node", "head")
    between = found.where("b IS NOT NULL AND NOT open").join(heads.toDF("a", "ha"), "a").join(heads.toDF("b", "hb"), "b")
    edges = edges.union(between.select("ha", "hb"))
    if inner is not None:
        links = links.union(inner.where("b IS NULL").select("a", "n"))
        edges = edges.union(inner.where("b IS NOT NULL").select("a", "b"))
    links = links.groupBy("a").agg(F.sum("n").alias("n_links"))
    classes = components(edges.where("a <> b"))
    return (
        slim.select("vec_id")
        .join(links, F.col("vec_id") == F.col("a"), "left")
        .join(classes, F.col("vec_id") == F.col("id"), "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )


def distances_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row."""
    return np.sqrt(np.maximum(2 - 2 * np.einsum("nd,nd->n", a, b), 0))


def _compared(nodes: DataFrame, leaves: Leaves, limit: float, threshold: float, width: int) -> DataFrame:
    """What the bounds of nodes (node, v, n, reach, leaf) say: rows (a, null, n, false): vectors linked with all of a; (a, b, 0, false):
    edges; (a, b, 0, true): pairs whose members must be compared."""

    def visiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                rows = pad(part.column("v").to_pylist(), width)
                reach, leaf = part.column("reach").to_numpy(), part.column("leaf").to_numpy()
                i, to = leaves.visits(rows, reach, leaf, limit)
                # where each node goes: home as a member, elsewhere as a guest
                i = np.concatenate([np.arange(len(rows)), i])
                to = np.concatenate([leaf, to])
                taken = part.select(["node", "v", "n", "reach"]).take(pa.array(i))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(to, pa.int64()), pa.array(np.arange(len(i)) >= len(rows))], names=["node", "v", "n", "reach", "leaf", "guest"])

    slim = nodes.select("node", "v", "n", "reach", "leaf")
    sent = written(slim.mapInArrow(visiting, "node long, v binary, n long, reach double, leaf long, guest boolean"), "vector-visits")
    counts = sent.groupBy("leaf").agg(F.ceil(F.count_if(~F.col("guest")) / BLOCK).cast("int").alias("nm"), F.ceil(F.count_if("guest") / BLOCK).cast("int").alias("ng"))
    dealt = sent.join(F.broadcast(counts), "leaf").withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("guest"), F.col("ng")).otherwise(F.col("nm"))).cast("int"))
    span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    # tasks (i, j): members i with members j from i on, or with guests j - nm
    own, nm, ng = F.col("own"), F.col("nm"), F.col("ng")
    last = nm + ng - 1
    pair = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    of_member = F.concat(F.transform(span(own, last), lambda j: pair(own, j, 0)), F.transform(span(F.lit(0), own - 1), lambda i: pair(i, own, 1)))
    of_guest = F.transform(span(F.lit(0), nm - 1), lambda i: pair(i, nm + own, 1))
    work = dealt.select("leaf", "nm", "node", "v", "n", "reach", F.explode(F.when(F.col("guest"), of_guest).otherwise(of_member)).alias("t"))
    work = work.select("leaf", "t.i", "t.j", "t.side", "node", "v", "n", "reach")

    def traverse(key, table):
        same = key[1].as_py() == key[2].as_py()
        trees, numbers = [], []
        side = table.column("side").to_numpy()
        for k in (0,) if same else (0, 1):
            part = table.filter(pa.array(side == k)).sort_by("node")
            rows = pad(part.column("v").to_pylist(), width)
            order, level = planted(rows)
            trees.append(Tree(rows[order], level, part.column("reach").to_numpy()[order], part.column("n").to_numpy()[order]))
            numbers.append(part.column("node").to_numpy()[order])
        left, right = numbers[0], numbers[-1]
        links_a, links_b, edges, opened = join(trees[0], trees[-1], limit, same, threshold)
        a, n = left[links_a > 0], links_a[links_a > 0]
        if not same:
            a, n = np.concatenate([a, right[links_b > 0]]), np.concatenate([n, links_b[links_b > 0]])
        pairs = edges + opened
        return pa.table({
            "a": pa.array(np.concatenate([a, left[[i for i, _ in pairs]]]) if pairs else a, pa.int64()), "b": pa.array([None] * len(a) + [int(right[j]) for _, j in pairs], pa.int64()),
            "n": pa.array(np.concatenate([n, np.zeros(len(pairs), np.int64)]), pa.int64()), "open": pa.array([False] * (len(a) + len(edges)) + [True] * len(opened), pa.bool_()),
        })

    return work.groupBy("leaf", "i", "j").applyInArrow(traverse, "a long, b long, n long, open boolean")


def _members_compared(members: DataFrame, pairs: DataFrame, threshold: float, width: int) -> DataFrame:
    """Links between the members (node, vec_id, v) of open pairs of nodes (a, b): rows (vec_id, null, n) and edges (vec_id, vec_id, 0).

    A task reads the members of a, then those of its partners one after the other; a node with many of these goes to as many tasks as
    they need."""
    sizes = members.where("first").select(F.col("node").alias("b"), "n")
    shares = pairs.join(sizes, "b").groupBy("a").agg(F.ceil(F.sum("n") / SLICE).cast("int").alias("shares"))
    rows = members.select("node", "vec_id", "v")
    first = rows.join(shares, F.col("node") == F.col("a")).select("a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(None).cast("long").alias("b"), "vec_id", "v")
    second = pairs.join(shares, "a").join(rows, F.col("b") == F.col("node")).select("a", F.pmod(F.xxhash64("b"), "shares").cast("int").alias("share"), "b", "vec_id", "v")
    dealt = first.unionByName(second).repartition("a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first(), "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors, base, totals, met = None, [], [], None, None, None

        def out(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "n"])

        def closed() -> list[tuple]:
            return [] if totals is None else [(i, None, int(n)) for i, n in zip(ids, totals, strict=True) if n]

        for batch in batches:
            found: list[tuple] = []
            todo: list[tuple[int, bytes]] = []

            def compare() -> None:
                nonlocal base, totals, met
                if not todo:
                    return
                if base is None:
                    base, totals, met = pad(vectors, width), np.zeros(len(ids), np.int64), [None] * len(ids)
                hit = pad([v for _, v in todo], width) @ base.T >= threshold
                totals += hit.sum(axis=0)
                for (other, _), line in zip(todo, hit, strict=True):
                    if line.any():
                        found.append((other, None, int(line.sum())))
                        found.extend((other, ids[k], 0) for k in np.flatnonzero(line)[:1].tolist())
                for k in np.flatnonzero(hit.any(axis=0)).tolist():
                    # the members of a node are linked with each other, so one edge joins the two nodes
                    if met[k] is None:
                        met[k] = todo[int(hit[:, k].argmax())][0]
                        found.append((ids[k], met[k], 0))
                todo.clear()

            for a, share, b, vec, v in zip(*(batch.column(c).to_pylist() for c in ("a", "share", "b", "vec_id", "v")), strict=True):
                if (a, share) != key:
                    compare()
                    found += closed()
                    key, ids, vectors, base, totals, met = (a, share), [], [], None, None, None
                if b is None:
                    ids.append(vec)
                    vectors.append(v)
                else:
                    todo.append((vec, v))
            compare()
            yield out(found)
        yield out(closed())

    return dealt.mapInArrow(run, "a long, b long, n long")


def pad(rows: list[bytes], width: int) -> np.ndarray:
    """Rows of doubles from bytes, shorter ones padded with zeros."""
    if not rows:
        return np.zeros((0, width // 8))
    if all(len(r) == width for r in rows):
        return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)
    return np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.float64).reshape(len(rows), -1)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, [x::DOUBLE for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v WHERE list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / a.size / b.size >= 0.9),
r AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
k AS (SELECT id, min(c) AS c FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, k.c AS component_id, k.c = e.vec_id AS kept
FROM embeddings e JOIN k ON k.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""

QUERIES = {"op4_near_duplicates": query}
ORACLE_SQL = {"op4_near_duplicates": SQL}
