import duckdb
import numpy as np
import pytest

from tessera.llm import neighbours


def clustered(rng, n, dim=16):
    centers = rng.normal(size=(max(2, n // 12), dim))
    rows = centers[rng.integers(0, len(centers), n)] + rng.normal(size=(n, dim)) * rng.choice([0, 0.02, 0.15, 0.3], size=(n, 1))
    rows[: n // 3] = rows[0] + rng.normal(size=(n // 3, dim)) * 0.05
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def brute(ids, rows, threshold=0.9):
    hit = rows @ rows.T >= threshold
    np.fill_diagonal(hit, False)
    label = list(ids)
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            low = min([label[i], *(label[j] for j in np.flatnonzero(hit[i]))])
            changed |= low < label[i]
            label[i] = low
    return {i: (int(h.sum()), c) for i, h, c in zip(ids, hit, label, strict=True)}


def tree_of(rows):
    order, level = neighbours.planted(rows)
    assert sorted(order) == list(range(len(rows)))
    return neighbours.Tree(rows[order], level)


def test_tree_covers_and_levels_are_nets():
    rng = np.random.default_rng(3)
    tree = tree_of(clustered(rng, 400))
    for number, radius in enumerate(neighbours.RADII, 1):
        starts, ends = tree.starts[number], tree.ends[number]
        assert starts[0] == 0 and (ends[:-1] == starts[1:]).all() and ends[-1] == 400
        assert set(tree.starts[number - 1]) <= set(starts)  # nested
        for s, e, r in zip(starts, ends, tree.radius[number], strict=True):
            assert neighbours.distances(tree.rows[s:e], tree.rows[s : s + 1]).max() <= max(r, 1e-7) + 1e-9
            assert r <= radius + 1e-9
        for p in range(len(tree.starts[number - 1])):
            heads = tree.rows[starts[list(tree.kids(number - 1, p))]]
            gaps = neighbours.distances(heads, heads) + 9 * np.eye(len(heads))
            assert gaps.min() > radius - 1e-9


@pytest.mark.parametrize("limit", [0.1, 0.4472135955, 1.0])
def test_dual_traversal_is_exact(limit, monkeypatch):
    rng = np.random.default_rng(4)
    rows = clustered(rng, 300)
    near = 1 - limit * limit / 2
    monkeypatch.setattr(neighbours, "SMALL", 30)
    a, b = tree_of(rows[:170]), tree_of(rows[170:])
    la, lb, _, left = neighbours.join(a, b, limit, False)
    assert not left
    hit = a.rows @ b.rows.T >= near
    assert (la == hit.sum(axis=1)).all() and (lb == hit.sum(axis=0)).all()
    own, _, edges, left = neighbours.join(a, a, limit, True)
    assert not left
    hit = a.rows @ a.rows.T >= near
    np.fill_diagonal(hit, False)
    assert (own == hit.sum(axis=1)).all()
    assert all(hit[i, j] for i, j in edges)


def test_nodes_stand_for_their_members():
    """Rows with a reach: what is counted and what stays open together are all links."""
    rng = np.random.default_rng(8)
    rows = clustered(rng, 260)
    order, level = neighbours.planted(rows)
    rows = rows[order]
    starts = np.flatnonzero(level <= 3)
    ends = np.append(starts[1:], len(rows))
    reach = np.array([neighbours.distances(rows[s:e], rows[s : s + 1]).max() for s, e in zip(starts, ends)]) * (ends - starts > 1)
    heads = rows[starts]
    o, lv = neighbours.planted(heads)
    tree = neighbours.Tree(heads[o], lv, reach[o], (ends - starts)[o])
    links, _, _, left = neighbours.join(tree, tree, 0.4472135955, True, 0.9)
    hit = rows @ rows.T >= 0.9
    np.fill_diagonal(hit, False)
    total = int((links * tree.weight).sum()) + int(((ends - starts) * (ends - starts - 1)).sum())
    for i, j in left:
        p, q = o[i], o[j]
        total += 2 * int((rows[starts[p] : ends[p]] @ rows[starts[q] : ends[q]].T >= 0.9).sum())
    assert total == hit.sum()


@pytest.mark.parametrize("block, pivots, cut, threshold", [(60, 3, 1 << 14, 0.9), (20, 5, 30, 0.9), (60, 3, 8, 0.97), (30, 4, 16, 0.999)])
def test_many_blocks(spark, monkeypatch, block, pivots, cut, threshold):
    for name, value in (("BLOCK", block), ("PIVOTS", pivots), ("SLICE", cut)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(5)
    rows = clustered(rng, 400)
    ids = [int(i) * 7 - 100 for i in rng.permutation(400)]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in zip(ids, rows, strict=True)], "vec_id long, embedding array<double>").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.near_duplicates(df, threshold).collect()}
    assert got == brute(ids, rows, threshold)


def test_visits_reach_every_link():
    rng = np.random.default_rng(9)
    rows = clustered(rng, 500)
    tops = rows[:6]
    leaves = neighbours.Leaves(tops, {0: rows[10:14], 3: rows[20:23]})
    leaf, gap, top, far = leaves.place(rows)
    np.maximum.at(leaves.radius, leaf, gap)
    np.maximum.at(leaves.top_radius, top, far)
    i, to = leaves.visits(rows, np.zeros(len(rows)), leaf, 0.4472135955)
    met = set(zip(i.tolist(), to.tolist(), strict=True))
    hit = rows @ rows.T >= 0.9
    for a, b in zip(*np.nonzero(hit), strict=True):
        if leaf[a] != leaf[b]:
            assert ((a, leaf[b]) in met) != ((b, leaf[a]) in met) or {(a, leaf[b]), (b, leaf[a])} <= met
            assert (a, leaf[b]) in met or (b, leaf[a]) in met


@pytest.mark.parametrize("size", [600, 3000])
def test_what_is_sent_grows_with_the_vectors(spark, monkeypatch, size):
    """Clustered vectors: a node goes home and to few other leaves, and a hot group is few nodes, whatever the number of vectors."""
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(40, 32))
    rows = centers[rng.integers(0, 40, size)] + rng.normal(size=(size, 32)) * 0.01
    rows[: size // 3] = centers[0]
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    sent = []
    plain = neighbours.written
    monkeypatch.setattr(neighbours, "written", lambda df, name: (lambda t: sent.append((name, t)) or t)(plain(df, name)))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in neighbours.near_duplicates(df).collect()}
    hit = rows @ rows.T >= 0.9
    assert all(got[i] == hit[i].sum() - 1 for i in range(size))
    visits = next(t for name, t in sent if name == "vector-visits").count()
    assert visits <= 1.5 * size / 3


def test_the_threshold_itself_links(spark):
    rows = [(1, [1.0, 0.0, 0.0, 0.0]), (2, [9.0, 3.0, 3.0, 1.0]), (3, [0.0, 0.0, 0.0, 1.0]), (4, [0.1, 0.3, 0.3, 0.9]), (5, [8.99, 3.0, 3.0, 1.0])]
    df = spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in neighbours.near_duplicates(df).collect()}
    assert got[1] == got[2] == 1  # a cosine of exactly 0.9
    assert neighbours.near_duplicates(spark.createDataFrame([rows[0], rows[4]], df.schema)).agg({"n_links": "sum"}).first()[0] == 0


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [1e-300, 0.0]), (10, [1e300, 1e299]), (None, [1.0, 0.0]), (11, [-1.0, 0.0]), (12, [5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS cell", "2 AS v")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in neighbours.near_duplicates(df).collect())
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 11)]
    assert got == sorted([(0, 0, None, True), (1, 4, 1, True), (2, 4, 1, False), (9, 4, 1, False), (10, 4, 1, False), (12, 4, 1, False), *alone])
    assert neighbours.near_duplicates(df.limit(0)).collect() == []
    assert neighbours.near_duplicates(df.where("vec_id = 5")).first().n_links == 0


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    assert sorted(map(tuple, neighbours.query(spark, sf_dir).collect())) == sorted(con.sql(neighbours.SQL).fetchall())
