"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Text is normalised as the model asks (dummy prefix, escaped spaces), cut into chunks that no
piece can cross, and every distinct chunk is encoded once per worker by a score-ordered agenda
of adjacent symbol pairs. New chunks of an Arrow batch are checked against the sentencepiece
library; a difference stops the job.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import map_texts, read

SPACE = "▁"
#: Distinct chunks of each of the two generations that a worker remembers; bounds its memory only.
MEMORY = 250_000
#: Chunks of up to so many symbols keep their agenda in a list, longer ones in a heap.
SHORT = 24
MODEL = "piece_bpe_32k.model"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Agenda:
    """A merge-type vocabulary and its encoder."""

    def __init__(self, path: str, memory: int | None = None):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces:
            raise ValueError("only merge-type models without a character map are supported")
        if not norm.escape_whitespaces or not norm.add_dummy_prefix or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that escape spaces and add a prefix are supported")
        self.memory = MEMORY if memory is None else memory
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, tuple[float, int]] = {}
        self.bytes = [-1] * 256
        self.unknown = 0
        self.names: list[str] = []
        self.kinds: list[int] = []
        for i, piece in enumerate(proto.pieces):
            self.names.append(piece.piece)
            self.kinds.append(piece.type)
            if piece.type == 1:
                self.pieces[piece.piece] = (piece.score, i)
            elif piece.type == 6:
                self.bytes[int(piece.piece[3:5], 16)] = i
            elif piece.type == 2:
                self.unknown = i
            elif piece.type != 3:
                raise ValueError("only normal, byte, control and unknown pieces are supported")
        self.surface = proto.trainer_spec.unk_surface
        self.plain_ids = frozenset(i for _, i in self.pieces.values())
        # a space may start a piece or fill it, so no piece crosses from other text to a space
        for name in self.pieces:
            if SPACE in name.lstrip(SPACE):
                raise ValueError("a piece holds a space after other text")
        joined = {c for name in self.pieces if len(name) > 1 for c in name}
        self.alone = "".join(c for c in map(chr, range(128)) if c not in joined)
        alone = re.escape(self.alone)
        self.chunk = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|[{alone}]")
        if "\n" not in self.alone:
            raise ValueError("a piece holds a line end and other text")
        #: chunk: its ids in decimal with a comma after each
        self.memo: dict[str, str] = {}
        self.older: dict[str, str] = {}
        #: chunk: its decoded text, where that is another one
        self.altered: dict[str, str] = {}

    def merge(self, chunk: str) -> list[str]:
        """Symbols of a chunk: the best-scored adjacent pair is joined first, the leftmost of equals."""
        return self._merge_list(chunk) if len(chunk) <= SHORT else self._merge_heap(chunk)

    def _merge_list(self, chunk: str) -> list[str]:
        pieces, none = self.pieces, (-math.inf, 0)
        symbols = list(chunk)
        agenda = [pieces.get(a + b, none)[0] for a, b in itertools.pairwise(symbols)]
        while agenda and (best := max(agenda)) > -math.inf:
            i = agenda.index(best)
            symbols[i] += symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = pieces.get(symbols[i] + symbols[i + 1], none)[0]
            if i:
                agenda[i - 1] = pieces.get(symbols[i - 1] + symbols[i], none)[0]
        return symbols

    def _merge_heap(self, chunk: str) -> list[str]:
        pieces = self.pieces
        symbols: list[str | None] = list(chunk)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            joined = symbols[i] + symbols[j]
            if (found := pieces.get(joined)) is not None:
                heapq.heappush(agenda, (-found[0], i, j, joined))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, joined = heapq.heappop(agenda)
            if symbols[i] is None or after[i] != j or symbols[j] is None or symbols[i] + symbols[j] != joined:
                continue  # one of the two has been joined since
            symbols[i], symbols[j] = joined, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [s for s in symbols if s is not None]

    def ids(self, chunk: str) -> tuple[int, ...]:
        out: list[int] = []
        for symbol in self.merge(chunk):
            if (found := self.pieces.get(symbol)) is not None:
                out.append(found[1])
            elif self.bytes[0] >= 0:
                out += [self.bytes[b] for b in symbol.encode()]
            else:
                out.append(self.unknown)
        return tuple(out)

    def chunks(self, text: str) -> list[str]:
        return self.chunk.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def learn(self, new: list[str]) -> None:
        """Encode chunks not met before and check all of them against the library, in one batch."""
        made = [self.ids(c) for c in new]
        # nothing joins a line end, so what the library makes of it and of its own prefix can be cut off
        checked = self.library.encode(["\n" + c.replace(SPACE, " ") for c in new], num_threads=1)
        for chunk, mine, ids in zip(new, made, checked, strict=True):
            if list(mine) != ids[2:]:
                raise AssertionError(f"agenda and library differ on {chunk!r}")
        for chunk, ids in zip(new, made, strict=True):
            self.memo[chunk] = ",".join(map(str, ids)) + ","
            if (surface := self.surfaces(ids)) != chunk:
                self.altered[chunk] = surface

    def coded(self, texts: list[str]) -> list[tuple[str, str]]:
        """For each text its ids in decimal with a comma after each, and its decoded text, escaped."""
        if len(self.memo) > self.memory:
            self.memo, self.older = {}, self.memo
            self.altered = {c: s for c, s in self.altered.items() if c in self.older}
        cut = [self.chunks(t) for t in texts]
        new = {c for chunks in cut for c in chunks}
        new.difference_update(self.memo)
        for c in [c for c in new if c in self.older]:
            self.memo[c] = self.older[c]
            new.discard(c)
        if new:
            self.learn(sorted(new))
        get, altered = self.memo.__getitem__, self.altered
        return [("".join(map(get, chunks)), "".join([altered.get(c, c) for c in chunks] if altered else chunks)) for chunks in cut]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [list(map(int, ids[:-1].split(","))) if ids else [] for ids, _ in self.coded(texts)]

    def surfaces(self, ids: Iterable[int]) -> str:
        """The pieces' text, spaces still escaped; runs of byte pieces become UTF-8."""
        ids = list(ids)
        if self.plain_ids.issuperset(ids):
            return "".join(map(self.names.__getitem__, ids))
        out: list[str] = []
        run = bytearray()
        for i in ids:
            kind, name = self.kinds[i], self.names[i]
            if kind == 6:
                run.append(int(name[3:5], 16))
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append("" if kind == 3 else self.surface if kind == 2 else name)
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    @staticmethod
    def plain(surface: str) -> str:
        """Without the dummy prefix, and with spaces."""
        return surface.removeprefix(SPACE).replace(SPACE, " ")

    def decode(self, ids: list[int]) -> str:
        return self.plain(self.surfaces(ids))


_loaded: dict[str, Agenda] = {}


def agenda(path: str) -> Agenda:
    if path not in _loaded:
        _loaded[path] = Agenda(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str | None = None, column: str = "text", memory: int = MEMORY) -> DataFrame:
    """doc_id, ids (array<int>), n_tokens and decoded for every row.

    ``memory`` bounds the chunks that a worker remembers, which saves time and changes no result.
    Null texts count as empty: no ids, an empty text. Equal rows are kept. Other columns are not read. Each Arrow
    batch is encoded on its own; nothing is shuffled, and a lost executor costs its partitions only.
    """
    return _digest(docs, path, column, True, memory)


def _digest(docs: DataFrame, path: str | None, column: str, whole: bool, memory: int) -> DataFrame:
    path = path or model_path()

    def make(texts: list[str]) -> list[list]:
        coder = agenda(path)
        coder.memory = memory
        codes = coder.coded(texts)
        counts = [ids.count(",") for ids, _ in codes]
        ids = [ids[:-1] for ids, _ in codes]
        decoded = [coder.plain(surface) for _, surface in codes]
        if whole:
            return [counts, [list(map(int, i.split(","))) if i else [] for i in ids], decoded]
        return [counts, *([hashlib.sha256(x.encode()).hexdigest() for x in part] for part in (ids, decoded))]

    made = {"ids": pa.list_(pa.int32()), "decoded": pa.string()} if whole else {"ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    return map_texts(docs, column, {"n_tokens": pa.int64(), **made}, make)


def digests(docs: DataFrame, path: str | None = None, memory: int = MEMORY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the digests of what ``encode`` returns, made in the same pass."""
    return _digest(docs, path, "text", False, memory)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))


QUERIES = {"op6_sentencepiece": query}
ORACLE_SQL: dict[str, str] = {}
