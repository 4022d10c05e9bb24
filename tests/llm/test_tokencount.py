import math
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import models

from tessera.llm import tokencount
from tessera.llm.pieces import SPACE, model_path

SCORES = tokencount.unigram_scores(model_path())
LIB = models.Unigram([("<unk>", 0.0), *SCORES.items()], 0, False)


def brute(word, scores, unknown):
    """Best segmentation by trying all, one word at a time: tokens, unknown neighbours as one."""
    best = [(0.0, 0, False)]
    for end in range(1, len(word) + 1):
        options = [(best[s][0] + scores[word[s:end]], best[s][1] + 1, False) for s in range(end) if word[s:end] in scores]
        if word[end - 1] not in scores:
            s, n, run = best[end - 1]
            options.append((s + unknown, n + (not run), True))
        best.append(max(options, key=lambda o: o[0]))
    return best[-1][1]


def test_table_against_library(spark, sf_dir):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    known = {}
    for r in tokencount.query(spark, sf_dir).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id])
        for w in words:
            if w not in known:
                known[w] = len(LIB.tokenize(SPACE + w))
        assert (r.n_words, r.n_tokens) == (len(words), sum(known[w] for w in words))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abcé☃漢q", min_size=1, max_size=9), min_size=1, max_size=12))
def test_trie_is_the_same_as_one_by_one(words):
    scores = {"a": -1.5, "b": -1.7, "ab": -2.1, "ba": -3.3, "abc": -2.9, "é": -4.0, "aé": -4.1, "qa": -5.0, "☃☃": -3.7}
    trie = tokencount.TrieCounter(scores)
    ordered = sorted(set(words))
    assert list(trie.walk(ordered)) == [brute(w, scores, min(scores.values()) - tokencount.UNKNOWN) for w in ordered]
    prefixes = {w[:i] for w in ordered for i in range(1, len(w) + 1)}
    assert trie.steps == len(prefixes)  # each trie node once


def test_scores_sum_to_one():
    assert math.isclose(sum(map(math.exp, SCORES.values())), 1)


def test_odd_rows(spark, monkeypatch):
    df = spark.createDataFrame([(1, None, 1), (1, None, 1), (None, "a a", 2), (2, " \n", 3), (3, "the " * 50000, 4)], "doc_id long, text string, n_tokens int")
    got = sorted(((r.doc_id or 0), r.n_words, r.n_tokens) for r in tokencount.token_counts(df).collect())
    assert got == [(0, 2, 2), (1, 0, 0), (1, 0, 0), (2, 0, 0), (3, 50000, 50000)]
    assert tokencount.token_counts(df.limit(0)).collect() == []
    monkeypatch.setattr(tokencount, "MEMORY", 3)
    trie = tokencount.TrieCounter(SCORES)
    for i in range(30):
        assert trie.counts([f"w{i} w{i} zz"])[0][0] == 3
    assert len(trie.memo) <= 6
