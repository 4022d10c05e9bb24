import hashlib
import re

import corpus_pipeline
import sentencepiece

from tessera.llm import jaccard, mixing, pieces, private, quality
from test_jaccard import brute as brute_classes


def test_stages_on_the_table(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    docs = read("documents")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "personal data", "mixing sources", "SentencePiece encoding"]
    (_, rules), (_, once), (_, scrub), (_, mix), (_, encode) = corpus_pipeline.STAGES
    a = rules(spark, docs, sf_dir)
    kept = {r.doc_id for r in quality.judge(docs, read("labels")).where("kept").collect()}
    rows_a = {r.doc_id: r for r in a.collect()}
    assert set(rows_a) == kept and a.columns == docs.columns
    good = {r.doc_id for r in read("labels").where("quality = 1").collect()}
    failed = {r.doc_id for r in quality.judge(docs, read("labels")).where("base_failed").collect()}
    assert len(good - failed - kept) <= 0.02 * len(good)
    a = spark.createDataFrame(list(rows_a.values()), docs.schema)
    b = once(spark, a, sf_dir)
    rows_b = {r.doc_id: r for r in b.collect()}
    assert set(rows_b) == {i for i, (_, c) in brute_classes([(r.doc_id, r.text) for r in rows_a.values()]).items() if i == c} and b.columns == docs.columns
    b = spark.createDataFrame(list(rows_b.values()), docs.schema)
    c = scrub(spark, b, sf_dir)
    rows_c = {r.doc_id: r for r in c.collect()}
    field = private.trained()
    for i, r in rows_c.items():
        assert r.text == private.redacted(rows_b[i].text, private.find(rows_b[i].text, field)[1]) and r.n_chars == len(r.text)
        assert not private.base_spans(r.text)
    assert set(rows_c) == set(rows_b)
    c = spark.createDataFrame(list(rows_c.values()), docs.schema)
    d = mix(spark, c, sf_dir)
    times = {}
    for r in d.collect():
        assert r == rows_c[r.doc_id]
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    want = {r.doc_id: r.copies for r in mixing.mix(c).collect()}
    assert times == {i: n for i, n in want.items() if n} and max(times.values()) <= 2
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    last = encode(spark, d, sf_dir).collect()
    assert len(last) == sum(times.values())
    for r in last[:50]:
        ids = lib.encode(rows_c[r.doc_id].text)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.n_tokens == len(ids)
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, last))


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "a b c", "en", "s", 5), (None, "a b c", "en", "s", 5), (2, "x@y.z", "en", None, 5), (2, "x@y.z", "en", None, 5), (3, "", "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS size", "2 AS kept", "3 AS key", "4 AS h")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.passing(df, labels).collect() == []
    assert sorted((r.doc_id or 0, r.text or "") for r in jaccard.one_of_each(df).collect()) == [(0, "a b c"), (0, "a b c"), (1, ""), (2, "x@y.z"), (3, "")]
    assert sorted((r.doc_id or 0, r.text, r.n_chars) for r in private.scrubbed(df).collect() if r.text) == [(0, "a b c", 5), (0, "a b c", 5), (2, "<EMAIL>", 7), (2, "<EMAIL>", 7)]
    got = mixing.mixed(df)
    assert got.columns == df.columns and all(re.match(r"a b c|x@y\.z", r.text) for r in got.collect())
    for stage in (jaccard.one_of_each, private.scrubbed, mixing.mixed):
        assert stage(df.limit(0)).collect() == []
