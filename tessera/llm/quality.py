"""Quality rules with risk-controlled thresholds.

Each rule rejects documents whose ratio lies above a cutoff. The cutoffs come from labelled
holdouts: per stratum and rule, cutoffs are tested from lax to strict with the exact binomial
tail for "this cutoff rejects more than ``risk`` of the good documents"; testing stops at the
first cutoff that cannot be certified (fixed sequence), and the level is divided by the number
of strata times rules (Bonferroni). With probability 1 - ``delta`` every rule in every stratum
then rejects at most ``risk`` of good documents, and the rules of a stratum together at most as many times
``risk`` as it has rules: what is promised for the verdict is ``total_risk``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import let, read, words, written

#: Cutoffs tested per rule, from lax to strict.
CUTOFFS = {
    "symbols": (2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1),
    "repeats": (0.48, 0.46, 0.44, 0.42, 0.4, 0.38, 0.36, 0.34, 0.32, 0.3, 0.28, 0.26, 0.24, 0.22, 0.2),
    "lines": (0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5, 0.45, 0.4),
}
RISK = 0.005
DELTA = 0.05


def total_risk(risk: float = RISK, cutoffs: dict = CUTOFFS) -> float:
    """Share of a stratum's good documents that its rules reject together at most, with probability 1 - DELTA."""
    return risk * len(cutoffs)


def repeated_words(tokens: Column) -> Column:
    """Words that stand in a window of three words found twice or more, the first included.

    The windows' 64-bit hashes are packed with their places and sorted; a window is repeated if a
    neighbour has the same whole hash. That finds all as long as different hashes differ in the upper
    bits that are kept. Where two do not, and in texts of more than 2**20 windows, whole hashes are
    sorted beside their places. One array per document: no row is exploded and nothing is shuffled.
    """

    def of(w: Column) -> Column:
        count = F.size(w) - 2
        hashes = F.when(
            count > 1,
            F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))),
        )
        return let(hashes, from_hashes)

    def from_hashes(h: Column) -> Column:
        mask = F.when(F.size(h) <= 1 << 14, (1 << 14) - 1).otherwise((1 << 20) - 1).cast("long")
        packed = F.when(F.size(h) <= 1 << 20, F.transform(h, lambda x, i: (x - x.bitwiseAND(mask)).bitwiseOR(i.cast("long"))))
        return let(F.struct(F.sort_array(packed).alias("p"), mask.alias("m")), lambda s: covered(F.coalesce(of_packed(h, s["p"], s["m"]), of_whole(h))))

    def of_packed(h: Column, p: Column, mask: Column) -> Column:
        """Places of repeated windows; null if there is nothing packed or the upper bits do not tell all hashes apart."""

        def upper(x: Column) -> Column:
            return x - x.bitwiseAND(mask)

        def whole(x: Column) -> Column:
            return F.get(h, x.bitwiseAND(mask).cast("int"))

        def same(x: Column, other: Column) -> Column:
            return F.coalesce((upper(x) == upper(other)) & (whole(x) == whole(other)), F.lit(False))

        near = F.filter(p, lambda x, i: F.coalesce(upper(x) == upper(F.get(p, i - 1)), F.lit(False)) | F.coalesce(upper(x) == upper(F.get(p, i + 1)), F.lit(False)))
        # runs of equal upper bits; a run has one whole hash if each of its direct neighbours has the same
        mixed = lambda n: F.exists(F.transform(n, lambda x, i: F.coalesce((upper(x) == upper(F.get(n, i + 1))) & (whole(x) != whole(F.get(n, i + 1))), F.lit(False))), lambda x: x)
        hits = lambda n: F.filter(n, lambda x, i: same(x, F.get(n, i - 1)) | same(x, F.get(n, i + 1)))
        return let(near, lambda n: F.when(~mixed(n), F.transform(hits(n), lambda x: x.bitwiseAND(mask))))

    def of_whole(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i"))))
        same = lambda x, other: F.coalesce(x["h"] == other["h"], F.lit(False))
        return let(pairs, lambda q: F.transform(F.filter(q, lambda x, i: same(x, F.get(q, i - 1)) | same(x, F.get(q, i + 1))), lambda x: x["i"]))

    def covered(found: Column) -> Column:
        places = F.sort_array(found)
        start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(
            places,
            start,
            lambda a, x: F.struct((x + 3).alias("end"), (a["n"] + x + 3 - F.greatest(x, a["end"])).alias("n")),
            lambda a: a["n"],
        )

    return F.coalesce(let(tokens, of), F.lit(0).cast("long"))


def features(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (long).

    Null texts count as empty. Lines are split at \\n and count if they hold a word.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    tokens = words(F.col("text"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    both = let(
        tokens,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.concat_ws("", w)).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return docs.withColumns(
        {"_w": both, "_l": of_lines, "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long")}
    ).select(
        *[F.col(c) for c in docs.columns if c not in _MADE],
        "_w.n_words", "_w.word_chars", "n_symbols", "_l.n_dup_lines", "_w.n_repeat_words", "_l.n_lines",
    )


_MADE = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "_w", "_l"}


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ratios() -> dict[str, Column]:
    return {
        "symbols": F.col("n_symbols") / F.greatest(F.col("n_words"), F.lit(1)),
        "repeats": F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1)),
        "lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    }


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p) with 0 < p < 1, summed in logarithms; 1 where k > n * p (no use is made of it)."""
    odds = math.log(p) - math.log1p(-p)
    first = n.cast("double") * F.lit(math.log1p(-p))
    start = F.struct(first.alias("term"), first.alias("sum"))

    def add(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i) + F.lit(odds)
        high, low = F.greatest(a["sum"], term), F.least(a["sum"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    terms = F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k > n * F.lit(p), F.lit(1.0)).otherwise(F.exp(F.aggregate(terms, start, add, lambda a: a["sum"])))


def thresholds(holdout: DataFrame, strata: str, risk: float = RISK, delta: float = DELTA, cutoffs: dict = CUTOFFS) -> DataFrame:
    """Per stratum one certified cutoff per rule: columns st, cut_<rule> (null: none certified, the rule stays off).

    ``holdout`` has the stratum, the counts of ``features`` and ``quality`` (1 good, 0 bad). All labelled rows are
    used; only counts per stratum leave the first pass. Among certified cutoffs the laxest that rejects the most bad
    documents is taken, so a rule that would catch nothing more stays as lax as it can.
    """
    sums = [F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("n")]
    for rule, value in ratios().items():
        sums += [F.sum(F.when((F.col("quality") == 1) & (value > c), 1).otherwise(0)).alias(f"{rule}_good_{i}") for i, c in enumerate(cutoffs[rule])]
        sums += [F.sum(F.when((F.col("quality") == 0) & (value > c), 1).otherwise(0)).alias(f"{rule}_bad_{i}") for i, c in enumerate(cutoffs[rule])]
    counts = written(holdout.groupBy(stratum(strata).alias("st")).agg(*sums), "quality-counts")
    families = max(1, counts.count()) * len(cutoffs)
    out = counts.select("st", "n", *[c for c in counts.columns if c not in ("st", "n")])
    for rule, grid in cutoffs.items():
        tests = F.array(*[
            F.struct(F.lit(float(c)).alias("cut"), F.col(f"{rule}_good_{i}").alias("k"), F.col(f"{rule}_bad_{i}").alias("bad"), F.lit(i).alias("i"))
            for i, c in enumerate(grid)
        ])
        passed = F.transform(tests, lambda t: F.struct(t["cut"].alias("cut"), t["bad"].alias("bad"), t["i"].alias("i"), (binomial_tail(t["k"], F.col("n"), risk) <= F.lit(delta / families)).alias("ok")))
        failed = F.array_min(F.transform(F.filter(passed, lambda t: ~t["ok"]), lambda t: t["i"]))
        certified = F.filter(passed, lambda t: (t["i"] < F.coalesce(failed, F.lit(len(grid)))) & (t["bad"] > 0))
        best = F.array_max(F.transform(certified, lambda t: F.struct(t["bad"].alias("bad"), (-t["i"]).alias("lax"), t["cut"].alias("cut"))))
        out = out.withColumn(f"cut_{rule}", best["cut"])
    return written(out.select("st", *[f"cut_{rule}" for rule in cutoffs]), "quality-cutoffs")


def stratum(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(column)), F.lit("null"))


def calibrated(slim: DataFrame, labels: DataFrame, risk: float, delta: float) -> DataFrame:
    """Cutoffs per stratum from the labelled rows of ``slim`` (_id, _st and the counts) that pass the base rule."""
    truth = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    holdout = slim.where(~base_failed()).join(truth, F.col("_id") == truth["doc_id"])
    return thresholds(holdout, "_st", risk, delta)


def judged(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` with base_failed and kept."""
    rows = rows.withColumn("_key", stratum("_st")).join(cuts, F.col("_key") == F.col("st"), "left")
    caught = F.lit(False)
    for rule, value in ratios().items():
        caught = caught | F.coalesce(value > F.col(f"cut_{rule}"), F.lit(False))
    return rows.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & ~caught})


def judge(docs: DataFrame, labels: DataFrame, strata: str = "lang", keep: tuple[str, ...] = ("doc_id",), risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The ``keep`` columns, the counts, base_failed and kept for every row of ``docs``.

    Labels with a null id or quality are not used; of several labels of a document the highest counts. Documents
    without a stratum form one of their own; a stratum without certified cutoffs is judged by the base rule alone.
    Equal rows get equal verdicts. The text is read once; the calibration runs on a slim written table.
    """
    chosen = docs.select("text", F.col(strata).alias("_st"), F.col("doc_id").alias("_id"), *[F.col(c).alias(f"k_{c}") for c in keep])
    slim = written(features(chosen).drop("text"), "quality-features")
    return judged(slim, calibrated(slim, labels, risk, delta)).select(
        *[F.col(f"k_{c}").alias(c) for c in keep],
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    )


def passing(docs: DataFrame, labels: DataFrame, strata: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their own columns.

    The counts are made once and written beside the rows; the calibration reads the counts alone, the verdicts then the rows.
    """
    whole = docs.select("text", F.col(strata).alias("_st"), F.col("doc_id").alias("_id"), F.struct(*[c for c in docs.columns if c != "text"]).alias("_row"))
    rows = written(features(whole), "quality-rows")
    cuts = calibrated(rows.drop("text", "_row"), labels, risk, delta)
    return judged(rows, cuts).where("kept").select(*[F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def _sql(risk: float = RISK, delta: float = DELTA, cutoffs: dict = CUTOFFS) -> str:
    """The same with windows and lists. A tail of the binomial is a sum of terms made with the logarithm of the gamma function."""
    grid = ", ".join(f"('{rule}', {i}, {c!r}::DOUBLE)" for rule, cuts in cutoffs.items() for i, c in enumerate(cuts))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('s' || lang, 'null') AS st, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
t AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n FROM g),
r AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM t, range(3) o(k) WHERE n > 1 GROUP BY rid),
f AS (SELECT w.rid, doc_id, st, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
v AS (SELECT rid, rule, value FROM b, LATERAL (VALUES ('symbols', n_symbols / greatest(n_words, 1)), ('repeats', n_repeat_words / greatest(n_words, 1)), ('lines', n_dup_lines / greatest(n_lines, 1))) x(rule, value)),
q AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IN (0, 1) GROUP BY 1),
h AS (SELECT rid, st, quality FROM b JOIN q USING (doc_id) WHERE NOT base_failed),
n AS (SELECT st, count(*) FILTER (quality = 1) AS n FROM h GROUP BY 1),
c AS (SELECT st, x.rule, i, cut, count(*) FILTER (quality = 1 AND value > cut) AS k, count(*) FILTER (quality = 0 AND value > cut) AS bad FROM h JOIN v USING (rid) JOIN (VALUES {grid}) x(rule, i, cut) ON x.rule = v.rule GROUP BY 1, 2, 3, 4),
p AS (SELECT c.*, k <= n * {risk} AND (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({risk}) + (n - j) * ln(1 - {risk}))) FROM range(k + 1) y(j)) <= {delta}::DOUBLE / (greatest(1, (SELECT count(*) FROM n)) * {len(cutoffs)}) AS ok FROM c JOIN n USING (st)),
e AS (SELECT *, bool_and(ok) OVER (PARTITION BY st, rule ORDER BY i) AS certified FROM p),
z AS (SELECT st, rule, arg_max(cut, bad * 1000 - i) AS cut FROM e WHERE certified AND bad > 0 GROUP BY 1, 2),
u AS (SELECT rid, bool_or(value > cut) AS caught FROM b JOIN v USING (rid) JOIN z ON z.st = b.st AND z.rule = v.rule GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(caught, false) AS kept FROM b LEFT JOIN u USING (rid)
"""


QUERIES = {"op8_quality_rules": query}
ORACLE_SQL = {"op8_quality_rules": _sql()}
