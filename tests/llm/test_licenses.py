import duckdb

from tessera.llm import licenses

TEXTS = [
    None, "", "\n", "x Under the\nMIT license! cc-by-nc CC BY NC cc by nc", "Licensed under CC BY-NC 4.0.", "apache license, VERSION 2", "mit apache nc license",
    "All rights\nreserved", "reserved all Rights", "This work is licensed under the GNU General Public License, version 3.", "under the mit licenseé", "under the mit License é",
    "licensed by gnu general public license version 3 the", "under the mit license " * 1500, "word " * 8000 + "cc by nc", "under under the mit license", "\x00mit\x7funder the mit license\x80",
]


def compare(spark, path):
    docs = spark.read.parquet(path)
    got = sorted(map(str, (tuple(r) for r in licenses.scan(docs).drop("found").collect())))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{path}/*.parquet'" if not path.endswith("documents.parquet") else f"create view documents as select * from '{path}'")
    want = sorted(map(str, con.sql(licenses.ORACLE_SQL["op2_license_scan"]).fetchall()))
    assert got == want
    return got


def test_odd_texts(spark, tmp_path):
    rows = [(i, t, "l") for i, t in enumerate(TEXTS)] + [(None, "cc by nc", "l"), (3, TEXTS[3], "l"), (3, TEXTS[3], "l")]
    spark.createDataFrame(rows, "doc_id long, text string, labels string").write.parquet(f"{tmp_path}/t")
    got = compare(spark, f"{tmp_path}/t")
    assert len(got) == len(rows)


def test_table(spark, sf_dir):
    compare(spark, f"{sf_dir}/documents.parquet")


def test_places_and_empty(spark):
    df = spark.createDataFrame([(1, "a Under the MIT license, cc by nc")], "doc_id long, text string")
    r = licenses.scan(df).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.score) == (8, 2, 1, 5, "cc-by-nc,mit", 1.0)
    assert {m.label for m in r.found} == {"mit", "cc-by-nc"}
    assert licenses.scan(df.limit(0)).collect() == []


def wrapped(text, width):
    out, line = [], ""
    for w in text.split():
        if line and len(line) + len(w) >= width:
            out.append(line)
            line = ""
        line = f"{line} {w}".strip()
    return "\n".join([*out, line])


def test_every_template_at_any_wrap(spark):
    """Each license text, wrapped at several widths, behind comment signs, with some words changed, inside other text."""
    filler = " ".join(f"filler{i}" for i in range(300))
    rows, want = [], {}
    for k, (label, text) in enumerate(licenses.TEMPLATES):
        words = text.split()
        missing = len(set(licenses.template_words(text))) - licenses.need(len(set(licenses.template_words(text))))
        for n, body in enumerate((wrapped(text, 40), wrapped(text, 76).replace("\n", "\n * "), f"{filler}\n{wrapped(text, 60)} {filler}", " ".join(["changed", *words[1:]]) if missing and words.count(words[0]) == 1 else text)):
            rows.append((10 * k + n, body))
            want[10 * k + n] = label
        # far too much of it is gone
        rows.append((10 * k + 9, " ".join(words[: len(words) // 2])))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, label in want.items():
        assert label in got[i].labels.split(","), (rows, label)
    half = {label: got[10 * k + 9].labels for k, (label, text) in enumerate(licenses.TEMPLATES) if label in ("mit", "isc", "zlib", "unlicense")}
    assert set(half.values()) == {""}


def test_blocks_are_no_lines(spark):
    texts = ["all of us\nreserved seats " + "word " * 300 + "rights", None, "All rights\nreserved", "All\n\nrights. Reserved", "reserved for all, rights"]
    got = {r.doc_id: (r.labels, r.score, [m.start for m in r.found]) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: ("", 0.0, []), 1: ("", 0.0, []), **{i: ("all-rights-reserved", 1.0, [0]) for i in (2, 3, 4)}}


def test_prefix_filter_is_exact():
    for _, text in licenses.TEMPLATES:
        words = sorted(set(licenses.template_words(text)))
        assert len(set(licenses.anchors()) & set(words)) >= len(words) - licenses.need(len(words)) + 1
