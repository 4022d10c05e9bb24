import random
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import jaccard


def brute_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = {i: brute_set(t) for i, t in rows}
    label = {i: i for i in sets}
    ids = [i for i in sets if sets[i]]
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(sets[i]), label[i]) for i in sets}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | st.text(alphabet=st.sampled_from("aAbÉé \t\n\x0b\x1f\xa0"), max_size=40), max_size=8))
def test_sets(texts):
    got = jaccard.shingle_sets(texts)
    names = {}
    for t, s in zip(texts, got, strict=True):
        want = brute_set(t)
        assert len(s) == len(want) and (np.diff(s.astype(object)) > 0).all()
        names[frozenset(want)] = s.tobytes()
        assert names.setdefault(frozenset(want), s.tobytes()) == s.tobytes()
    assert len(set(names.values())) == len(names)


def corpus(rng, n):
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    passage = [word() for _ in range(60)]
    bases = [[word() for _ in range(rng.randint(6, 60))] for _ in range(12)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.5:  # a near copy with few to many edits
            w = list(bases[0] if kind < 0.3 else rng.choice(bases))
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = word()
        elif kind < 0.8:  # mostly the common passage
            w = [word() for _ in range(rng.randint(0, 30))] + passage
        else:
            w = [word() for _ in range(rng.randint(0, 40))]
        rows.append((i, " ".join(w)))
    return rows


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "REGION", 6)
    monkeypatch.setattr(jaccard, "BLOCK", 20)
    rows = corpus(random.Random(3), 420)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df).collect()}
    assert got == brute(rows)
    monkeypatch.setattr(jaccard, "DEMOTED", 2)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df.repartition(3)).collect()}
    assert got == brute(rows)


def cluster(rng, n, edits):
    """Near copies of one text with up to ``edits`` changed words each, a chain of drifting copies, and texts that share a passage only."""
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    base = [word() for _ in range(90)]
    rows, drift = [], list(base)
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = word()
        rows.append(w)
    for _ in range(n // 4):
        drift[rng.randrange(len(drift))] = word()
        rows.append(list(drift))
    rows += [base[:40] + [word() for _ in range(30)] for _ in range(n // 4)]
    rng.shuffle(rows)
    return [(3 * i + 1, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("edits, pivots, rounds", [(2, 3, 4), (9, 2, 1), (9, 2, 0)])
def test_document_pivots(spark, monkeypatch, edits, pivots, rounds):
    """Crowded regions of near copies: whatever the pivots settle, the classes are those of all pairs."""
    for name, value in (("REGION", 5), ("BLOCK", 12), ("SLICE", 16), ("PIVOTS", pivots), ("ROUNDS", rounds), ("PROGRESS", 1.0)):
        monkeypatch.setattr(jaccard, name, value)
    rows = cluster(random.Random(edits), 120, edits)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df).collect()}
    assert got == brute(rows)


def test_pivots_spare_a_hot_group_its_pairs(spark, monkeypatch):
    """Of a large group of near copies only what no pivot reaches goes to blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", 12)
    rows = cluster(random.Random(2), 200, 2)[:200]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    work = jaccard.Join(df)
    members = df.selectExpr("1L AS s", "doc_id AS x")
    labelled, (pivots, measured), edges = work.pivoted(members)
    parts = sorted((r["count"] for r in labelled.groupBy("c").count().collect()), reverse=True)
    assert parts[0] > len(rows) / 2 and pivots.count() <= jaccard.PIVOTS * jaccard.ROUNDS and measured.count() <= len(rows) * pivots.count() and edges.count() > len(rows) / 2


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_texts_made_to_collide_stay_apart(spark):
    """The Thue-Morse word and its complement share every polynomial hash modulo a power of two."""
    rows, k = [], 1
    for size in (8, 9, 16, 60, 64, 65, 1024, 2048):
        word = thue_morse(size)
        for w in (word, word.translate(str.maketrans("ab", "ba"))):
            rows += [(k, w), (k + 1, f"{w} one two three four five")]
            k += 2
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(i == c for i, c in got.items())
    assert len({s.tobytes() for s in jaccard.shingle_sets([t for _, t in rows])}) == len(rows)


def test_links_are_confirmed_on_words():
    texts = ["a b c d e f", "a b c d e f", "a b c d e g", None]
    check = jaccard.Confirmed(texts)
    assert check(0, 1) and not check(0, 2) and not check(0, 3) and not check(3, 3)
    same = [np.arange(9, dtype=np.uint64)] * 2  # sets of hashes that are equal by accident
    every = np.ones(2, bool)
    assert jaccard.block_links(same, every, every) == [(0, 1)]
    assert jaccard.block_links(same, every, every, confirm=lambda i, j: False) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aAbBé \t"), max_size=30), max_size=6))
def test_word_shingles(texts):
    for t in texts:
        assert {tuple(x.decode().split(" ")) for x in jaccard.word_shingles(t)} == brute_set(t)


def test_one_of_each_loses_no_text(spark):
    one, two = (" ".join(f"{k}{i}" for i in range(40)) for k in "ab")
    rows = [(1, one), (2, one), (2, two), (2, two), (3, two + " x"), (4, "other words"), (4, "more"), (None, one), (None, one), (5, None)]
    got = sorted((r.doc_id or 0, r.text or "") for r in jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    texts = [t for _, t in got]
    assert texts.count("other words") == texts.count("more") == 1
    assert sum(t in (two, two + " x") for t in texts) == 1 and [t for i, t in got if i and t == one] == [one]
    assert got.count((0, one)) == 2 and (5, "") in got


def test_block_links():
    rng = random.Random(5)
    rows = corpus(rng, 150)
    sets = jaccard.shingle_sets([t for _, t in rows])
    sets = [s for s in sets if len(s)]
    half = np.arange(len(sets)) % 2 == 0
    for left, right in ((half, ~half), (half | True, half | True)):
        part = list(range(len(sets)))
        for a, b in jaccard.block_links(sets, left, right):
            assert jaccard.linked(jaccard.common(sets[a], sets[b]), len(sets[a]) + len(sets[b]))
            part = [min(part[a], part[b]) if p in (part[a], part[b]) else p for p in part]
        for a in np.flatnonzero(left):
            for b in np.flatnonzero(right):
                if jaccard.linked(jaccard.common(sets[a], sets[b]), len(sets[a]) + len(sets[b])):
                    assert part[a] == part[b]


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A\tb"), (6, "a b c d e"), (7, long), (8, long + " x"), (9, "é b"), (10, "É b"), (-1, "a b c d e f"), (4, "a b c d e"), (6, "a b c d e"), (None, "a b"), (1 << 60, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS fp")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.join(df).collect())
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (5, 1, 4), (6, 1, 4), (6, 1, 4), (7, 29996, 7), (8, 29997, 7), (9, 1, 9), (10, 1, 10), (-1, 2, -1), (1 << 60, 1, 4)]
    assert got == sorted([(False, *w) for w in want] + [(True, 0, 1, None)])
    assert jaccard.join(df.limit(0)).collect() == []
    assert jaccard.join(df.where("doc_id = 1")).count() == 1


def test_an_id_with_several_texts(spark):
    one, two = (" ".join(f"{k}{i}" for i in range(40)) for k in "ab")
    rows = [(1, one), (2, one), (2, two), (3, two + " x"), (4, "other")]
    got = {(r.doc_id, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_large_components_are_decided_by_pairs(spark, monkeypatch):
    rows = corpus(random.Random(8), 150)
    monkeypatch.setattr(jaccard, "TOGETHER", 3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    assert sorted(map(tuple, jaccard.query(spark, sf_dir).collect())) == sorted(con.sql(jaccard.SQL).fetchall())
