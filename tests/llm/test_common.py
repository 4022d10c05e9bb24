import random

from tessera.llm.common import components, shared_folder, written


def brute(edges):
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_components(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(1000, 1120)]
    star = [(5000, i) for i in range(5001, 5200)]
    mixed = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    edges = chain + star + mixed + [(7, 7), (-3, 2), (-3, 2)]
    df = spark.createDataFrame(edges + [(None, 1), (1, None)], "a long, b long")
    got = {r.id: r.component_id for r in components(df).collect()}
    assert got == brute(edges)
    assert components(df.limit(0)).collect() == []


def test_written_tables_go_to_the_shared_folder(spark):
    df = written(spark.range(3), "three")
    assert df.count() == 3
    folder = shared_folder(spark).removeprefix("file://")
    assert all(folder in name for name in df.inputFiles())
