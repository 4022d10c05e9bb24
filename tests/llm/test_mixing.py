import duckdb
import pytest

from tessera.llm import mixing


def fill(sizes, share=1.5, weights=(3, 1, 2)):
    """Water filling round by round."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        total = sum(w[s] for s in open_)
        full = {s for s in open_ if left * w[s] / total >= 2 * sizes[s]}
        if not full:
            return target | {s: left * w[s] / total for s in open_}
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return target


def test_against_rounds_and_limits(spark):
    rows = [(i, "w " * (1 + i * 7 % 50), ["a", "b", "c", None, "é"][min(i % 9, 4)]) for i in range(900)] + [(None, None, "a"), (1007, "", "b"), (1008, "x y", "zz"), (1008, "x y", "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = fill(sizes)
    by, home = {}, {i: s for i, _, s in rows}
    for r in got:
        assert r.taken <= 2 * r["size"] and r.taken % max(r["size"], 1) == 0
        by.setdefault(home[r.doc_id], [r.target, 0])[1] += r.taken
    assert {s: round(t, 6) for s, (t, _) in by.items()} == {s: round(t, 6) for s, t in want.items()}
    for target, taken in by.values():
        assert abs(target - taken) <= 55
    assert sum(t for _, t in by.values()) <= 1.5 * sum(sizes.values())
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    assert len({(r.key, r.place) for r in got}) == len(rows)


def test_hot_rows_and_deep_steps(spark, monkeypatch):
    """A third of the rows equal, without an id; the step in which the budget ends is cut until one row is left in it."""
    rows = [(None, "a b c", "s")] * 150 + [(None, f"x y{i % 4}", "s") for i in range(60)] + [(i, "w " * (1 + i % 5), "st"[i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plain = sorted(map(str, mixing.mix(df).drop("place").collect()))
    assert len(plain) == len(rows)
    for name, value in (("STRETCH", 7), ("ONE_BY_ONE", 1), ("BUCKETS", 16)):
        monkeypatch.setattr(mixing, name, value)
    assert sorted(map(str, mixing.mix(df.repartition(3)).drop("place").collect())) == plain
    total = sum(len(t.split()) for _, t, _ in rows)
    taken = sum(r.taken for r in mixing.mix(df).collect())
    assert 1.5 * total - 6 < taken <= 1.5 * total
    con = duckdb.connect()
    documents = df.toPandas()  # noqa: F841
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    monkeypatch.undo()
    con.register("documents", documents)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:3], r[4])
    assert sorted(map(key, con.sql(mixing.SQL).fetchall())) == sorted(key(tuple(r)) for r in mixing.mix(df).drop("copies", "key", "place").collect())


def test_no_row_stands_for_another(spark):
    long = "w " * 50_000
    rows = [(1, "a b", "s", "x"), (1, "c d", "s", "x"), (1, "c d", "s", "y"), (1, "c d", "s", "y"), (1, "c d", "t", "x"), (None, "e f", "s", "p"), (None, "e f", "s", "q"), (2, long, "t", None), (3, None, "s", "x"), (4, "", "s", "x")]
    rows += [(i, "g h", "u", "z") for i in range(10, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").selectExpr("*", "1 AS copies", "2 AS place", "3 AS size", "4 AS h")
    copies = [r.copies for r in mixing.mix(df).orderBy("key", "place").collect()]
    got = mixing.mixed(df)
    assert got.columns == df.columns and got.count() == sum(copies)
    every = mixing.mixed(df, share=2.0)
    seen = {}
    for r in every.collect():
        key = (r.doc_id, r.text, r.source, r.lang)
        seen[key] = seen.get(key, 0) + 1
    want = {}
    for r in rows:
        if (r[1] or "").split():
            want[r] = want.get(r, 0) + 2  # each source is taken twice, so every row is
    assert seen == want


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def test_sql(spark, sf_dir):
    got = sorted(map(tuple, mixing.query(spark, sf_dir).collect()))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = sorted(con.sql(mixing.SQL).fetchall())
    assert [x[:3] + x[4:] for x in got] == [x[:3] + x[4:] for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want], rel=1e-12)
