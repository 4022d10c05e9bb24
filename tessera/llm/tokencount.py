"""Token counts under a unigram model, shared along a trie of pre-tokens.

A pre-token is a word with the escaped space before it. The distinct new pre-tokens of an Arrow
batch are walked as a trie in sorted order: the forward scores (best segmentation of every prefix)
of a shared prefix are computed once, and each pre-token's terminal count is stored.

The vocabulary is that of a public tokenizer. Its file holds merge ranks, not probabilities, so the
unigram scores follow a rule, not training: log p(rank) by Zipf's law.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import map_texts, read
from tessera.llm.pieces import SPACE, model_path

#: Pre-tokens of each of the two generations that a worker remembers; bounds its memory only.
MEMORY = 200_000
#: An unknown character costs so much more than the rarest piece; neighbours count as one token.
UNKNOWN = 10.0
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def unigram_scores(path: str) -> dict[str, float]:
    """Normal pieces of a sentencepiece file in file order, with Zipf's log probabilities."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    names = [p.piece for p in proto.pieces if p.type == 1]
    total = math.log(sum(1 / (i + 1) for i in range(len(names))))
    return {name: -math.log(i + 1) - total for i, name in enumerate(names)}


class TrieCounter:
    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores))
        self.unknown = min(scores.values()) - UNKNOWN
        # the lengths that pieces with a given last character have: fewer look-ups
        ends: dict[str, set[int]] = {}
        for name in scores:
            ends.setdefault(name[-1], set()).add(len(name))
        self.lengths = {c: sorted(v) for c, v in ends.items()}
        self.memo: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.steps = 0

    def walk(self, ordered: list[str]) -> Iterator[int]:
        """Terminal counts of sorted distinct pre-tokens.

        best, count and open hold, per prefix length on the current trie path, the forward score, the tokens of
        the best segmentation and whether it ends in unknown characters. Going to the next pre-token keeps the
        nodes of the common prefix. Of equal scores the one with the longer last piece stays.
        """
        scores, lengths, unknown = self.scores, self.lengths, self.unknown
        best, count, open_ = [0.0], [0], [False]
        previous = ""
        for word in ordered:
            shared, most = 0, min(len(previous), len(word))
            while shared < most and previous[shared] == word[shared]:
                shared += 1
            del best[shared + 1 :], count[shared + 1 :], open_[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                top, n, run = -math.inf, 0, False
                single = False
                for size in reversed(lengths.get(word[end - 1], ())):
                    if size > end:
                        continue
                    at = scores.get(word[end - size : end])
                    if at is not None:
                        single = single or size == 1
                        if best[end - size] + at > top:
                            top, n, run = best[end - size] + at, count[end - size] + 1, False
                if not single and best[end - 1] + unknown > top:
                    top, n, run = best[end - 1] + unknown, count[end - 1] + (not open_[end - 1]), True
                best.append(top)
                count.append(n)
                open_.append(run)
                self.steps += 1
            previous = word
            yield count[len(word)]

    def counts(self, texts: list[str]) -> list[tuple[int, int]]:
        """(words, tokens) of every text."""
        if len(self.memo) > MEMORY:
            self.memo, self.older = {}, self.memo
        cut = [WORD.findall(t) for t in texts]
        new = {w for words in cut for w in words}
        new.difference_update(self.memo)
        for w in [w for w in new if w in self.older]:
            self.memo[w] = self.older[w]
            new.discard(w)
        if new:
            ordered = sorted(new)
            self.memo.update(zip(ordered, self.walk([SPACE + w for w in ordered]), strict=True))
        get = self.memo.__getitem__
        return [(len(words), sum(map(get, words))) for words in cut]


_loaded: dict[str, TrieCounter] = {}


def counter(path: str) -> TrieCounter:
    if path not in _loaded:
        _loaded[path] = TrieCounter(unigram_scores(path))
    return _loaded[path]


def token_counts(docs: DataFrame, path: str | None = None, column: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens (long) per row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+``. Null and empty texts have 0 of both. Equal rows are kept; other columns are
    not read. Nothing is shuffled: each worker walks the trie of the words new to it, batch by batch.
    """
    path = path or model_path()

    def make(texts: list[str]) -> list[list]:
        made = counter(path).counts(texts)
        return [[m[0] for m in made], [m[1] for m in made]]

    return map_texts(docs, column, {"n_words": pa.int64(), "n_tokens": pa.int64()}, make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))


QUERIES = {"op9_token_counts": query}
ORACLE_SQL: dict[str, str] = {}
