import math
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from tessera.llm import quality


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(zip(w, w[1:], w[2:]))
    inside = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_counts(spark):
    texts = [None, "", " \t\n ", "a", "a b", "a b c", "a a a a", "a b c a b c", "x a b c y a b c z\nq\nq\n\n", "é# é# é# é#\n$ <>", "a b a b a b\r\n" * 3, "w " * 20000 + "z y x", " ".join(str(i % 9) for i in range(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.features(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_long_texts(spark):
    # windows found twice stand alone between words of their own, so each one that is missed shows in the count
    n = 150_000
    text = " ".join(f"a{i % n} b{i % n} c{i % n} u{i}" for i in range(2 * n))
    df = spark.createDataFrame([(1, text), (2, text[: len(text) // 40] * 2)], "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in quality.features(df).collect()}
    assert got == {1: 6 * n, 2: brute(text[: len(text) // 40] * 2)[-1]}


def test_binomial_tail(spark):
    cases = [(0, 10, 0.1), (3, 100, 0.05), (2, 4000, 0.005), (19, 4000, 0.005), (900, 200000, 0.005)]
    for k, n, p in cases:
        got = spark.range(1).select(quality.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
        assert abs(got - want) <= 1e-6 * want


def test_verdicts(spark):
    good = " ".join(f"w{i * i % 701}x{i}" for i in range(80))
    junk = " ".join(f"w{i}x***" for i in range(80))
    rows = [(i, f"{good} {i}", "en") for i in range(6000)] + [(10000 + i, f"{junk} {i}", "en") for i in range(300)] + [(20000, junk, None), (20001, good, None), (20002, "short", "en"), (None, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("kept", F.lit("x"))
    labels = spark.createDataFrame([(i, 1) for i in range(6000)] + [(10000 + i, 0) for i in range(200)] + [(None, 1), (5, None), (5, 1)], "doc_id long, quality int")
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.judge(docs, labels).collect()}
    assert all(got[i] == (False, True) for i in range(6000))
    assert all(got[10000 + i] == (False, False) for i in range(300))
    assert got[20000] == got[20001] == (False, True)  # no labels in this stratum: only the base rule
    assert got[20002] == got[None] == (True, False)
    few = {r.doc_id: r.kept for r in quality.judge(docs.where("doc_id between 5990 and 10010"), labels).collect()}
    assert all(few.values())  # too few labels to certify any cutoff
    assert quality.judge(docs.limit(0), labels).collect() == []
    assert quality.judge(docs.where("doc_id = 1"), labels.limit(0)).first().kept


def brute_cutoffs(rows, labels):
    """Cutoffs by stratum and rule, tested one after the other with sums of binomial terms; rows: id, stratum, counts of ``brute`` and lines."""
    value = {
        "symbols": lambda c: c[2] / max(c[0], 1), "repeats": lambda c: c[4] / max(c[0], 1), "lines": lambda c: c[3] / max(c[5], 1),
    }
    held = [(st, c, labels[i]) for i, st, c in rows if i in labels and c[0] >= 50 and 2 * c[4] <= c[0]]
    strata = {st for st, _, _ in held}
    level, out = quality.DELTA / (len(strata) * len(quality.CUTOFFS)), {}
    for st in strata:
        n = sum(q for s, _, q in held if s == st)
        for rule, cuts in quality.CUTOFFS.items():
            best = None
            for cut in cuts:
                over = [q for s, c, q in held if s == st and value[rule](c) > cut]
                k, bad = sum(over), len(over) - sum(over)
                tail = sum(math.comb(n, j) * quality.RISK**j * (1 - quality.RISK) ** (n - j) for j in range(k + 1)) if k <= n * quality.RISK else 1
                if tail > level:
                    break
                if bad and (best is None or bad > best[0]):
                    best = (bad, cut)
            if best:
                out[st, rule] = best[1]
    return out, value


def test_cutoffs_and_verdicts_on_the_table(spark):
    """The larger table has a stratum with enough labels to certify cutoffs."""
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    docs = read("documents").collect()
    labels = {r.doc_id: r.quality for r in read("labels").where("quality IN (0, 1)").collect()}
    rows = [(r.doc_id, r.lang, (*brute(r.text), len([x for x in (r.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]))) for r in docs]
    cutoffs, value = brute_cutoffs(rows, labels)
    assert cutoffs
    got = {r.doc_id: r for r in quality.query(spark, "/root/testdata/sf0.1").collect()}
    assert len(got) == len(rows)
    for i, st, c in rows:
        failed = c[0] < 50 or 2 * c[4] > c[0]
        caught = any(s == st and value[rule](c) > cut for (s, rule), cut in cutoffs.items())
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == (*c[:5], failed, not failed and not caught)
    for st in {s for s, _ in cutoffs}:
        good = [got[i] for i, s, _ in rows if s == st and labels.get(i) == 1 and not got[i].base_failed]
        assert sum(not r.kept for r in good) <= quality.total_risk() * len(good)


def test_sql_and_repeated_rows(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = sorted(con.sql(quality.ORACLE_SQL["op8_quality_rules"]).fetchall())
    assert sorted(map(tuple, quality.query(spark, sf_dir).collect())) == want
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    kept = sorted(r.doc_id for r in quality.passing(docs, labels).collect())
    assert kept == [w[0] for w in want if w[-1]]
    again = docs.unionByName(docs.where("doc_id % 3 = 0"))
    twice = sorted(r.doc_id for r in quality.passing(again, labels).collect())
    assert twice == sorted(kept + [i for i in kept if i % 3 == 0])  # too few labels here for the repetition to matter
