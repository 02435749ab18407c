"""SentencePiece encoding and decoding by a forward pass shared between words with a common prefix.

A normalised text is cut into marked words (the mark U+2581 stands for the space before a word) at places no piece spans.
The distinct words of a batch are sorted, which lays them out as a depth-first walk of their trie: the forward table of a word
keeps the entries of the prefix that it shares with the word before, and only the rest is filled.

For unigram models the table is Viterbi's: the best score of each prefix and where its last piece starts. The public model
here is BPE, for which the best sum of scores is not what the model means, so its table holds the last piece of the BPE
encoding of each prefix. That is well defined without running merges over the word: of the pieces that end at a place,
exactly one is compatible with the last piece of what precedes it, where two pieces are compatible if the merges turn their
joined text into just these two. Compatibility is found once for a pair and remembered. Words with several marks in a row,
whose merges tie in score, are merged directly. Ids equal those of the sentencepiece library.

Characters without a piece become byte pieces (or the unknown id in models without these). Decoding joins pieces and bytes,
turns marks into spaces and drops the first. Null and empty texts have no ids. Repeated rows are encoded each.
Columns named in ``keep`` are carried; the columns added are ``ids``, ``n_ids`` and ``round_trip``, and a column of ``keep`` with one of these names gives way.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, tidy

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Words that a worker remembers: when half as many are new, the older half goes, but for words met since.
CACHE_WORDS = 300_000
#: Pairs of pieces that a worker remembers before it starts afresh.
CACHE_PAIRS = 300_000
#: Bytes of text that are encoded at once, about: the more words, the more prefixes are shared.
TEXT_BYTES = 2 << 20
#: How far below the worst piece an unknown character scores in a unigram model.
UNKNOWN_PENALTY = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        elif kind == 5:
            yield tag >> 3, struct.unpack_from("<f", data, at)[0]
            at += 4
        elif kind == 1:
            yield tag >> 3, data[at : at + 8]
            at += 8
        else:
            raise ValueError("not a piece model")


def _shared(a: str, b: str) -> int:
    """How many first characters two words share."""
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


class PieceModel:
    """Pieces of a model with the encoder and decoder over them."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int, byte_fallback: bool = False, dummy_prefix: bool = True, normalize=None) -> None:
        self.kind, self.byte_fallback, self.dummy_prefix, self.normalize = kind, byte_fallback, dummy_prefix, normalize
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, USER, UNUSED)}
        self.score = {p: s for p, s, t in pieces if t in (NORMAL, USER, UNUSED)}
        self.unknown = next((i for i, x in enumerate(pieces) if x[2] == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.raw = [bytes([int(p[3:5], 16)]) if t == BYTE else p.encode() if t in (NORMAL, USER, UNUSED) else b" \xe2\x81\x87 " if t == UNKNOWN else b"" for p, _, t in pieces]
        self.longest = max(map(len, self.ids), default=1)
        self.worst = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        self.cut_marks = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.cut_lines = not any("\n" in p and len(p) > 1 for p in self.ids)
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.found = ahocorasick.Automaton()  # all pieces that end at a place, longest first
        for p, i in self.ids.items():
            self.found.add_word(p, (i, len(p)))
        if len(self.found):
            self.found.make_automaton()

    @classmethod
    def load(cls, path: str) -> PieceModel:
        with open(path, "rb") as f:
            data = f.read()
        pieces, kind, fallback, dummy, plain = [], UNIGRAM, False, True, True
        for n, v in _fields(data):
            if n == 1:
                own = dict(_fields(v))
                pieces.append((own.get(1, b"").decode(), own.get(2, 0.0), own.get(3, NORMAL)))
            elif n == 2:
                own = dict(_fields(v))
                kind, fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
            elif n == 3:
                own = dict(_fields(v))
                dummy = bool(own.get(3, 1))
                plain = not own.get(2) and not own.get(4, 1)
        normalize = None
        if not plain:
            import sentencepiece

            normalize = sentencepiece.SentencePieceProcessor(model_file=path).normalize
        return cls(pieces, kind, fallback, dummy, normalize)

    def merged(self, word: str) -> list[str]:
        """Pieces of a word by BPE merges: best score first, leftmost among equals."""
        parts: list[str | None] = list(word)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        heap = []

        def offer(a: int, b: int) -> None:
            joined = parts[a] + parts[b]
            if joined in self.ids:
                heapq.heappush(heap, (-self.score[joined], a, b, joined))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, joined = heapq.heappop(heap)
            if parts[a] is None or parts[b] is None or after[a] != b or parts[a] + parts[b] != joined:
                continue
            parts[a], parts[b] = joined, None
            after[a] = after[b]
            if after[b] < len(parts):
                before[after[b]] = a
                offer(a, after[b])
            if before[a] >= 0:
                offer(before[a], a)
        return [p for p in parts if p is not None]

    def _fits(self, left: int, right: int) -> bool:
        """Whether merges turn the joined text of two pieces into just these two."""
        if len(self.pairs) > CACHE_PAIRS:
            self.pairs.clear()
        a, b = self.text[left], self.text[right]
        found = self.pairs[left << 24 | right] = self.merged(a + b) == [a, b]
        return found

    def _alone(self, piece: int) -> bool:
        found = self.whole[piece] = self.merged(self.text[piece]) == [self.text[piece]]
        return found

    @cached_property
    def text(self) -> dict[int, str]:
        return {i: p for p, i in self.ids.items()}

    def _ids_of(self, parts: list[str]) -> bytes:
        out: list[int] = []
        gap = False
        for p in parts:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.byte_fallback:
                out += [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
            elif not gap:
                out.append(self.unknown)
            gap = i is None
        return np.asarray(out, dtype="<i4").tobytes()

    def walk(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """Each of the sorted distinct words with its pieces; the forward table is kept along common prefixes."""
        return self._walk_merges(words) if self.kind == BPE else self._walk_scores(words)

    def _walk_scores(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """Viterbi: the best sum of scores of each prefix, and its last piece."""
        ids, score, longest = self.ids, self.score, self.longest
        last: list = [""]
        best = [0.0]
        previous = ""
        for word in words:
            shared = _shared(word, previous)
            del last[shared + 1 :], best[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                found, top = None, 0.0
                for j in range(max(0, i - longest), i):
                    piece = word[j:i]
                    if piece in ids or j == i - 1:
                        s = best[j] + (score[piece] if piece in ids else self.worst)
                        if found is None or s > top:
                            found, top = piece, s
                last.append(found)
                best.append(top)
            previous = word
            parts, at = [], len(word)
            while at:
                parts.append(last[at])
                at -= len(last[at])
            yield word, parts[::-1]

    def _walk_merges(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """The last piece of the encoding of each prefix, as id (-1: a character without piece) and length."""
        find, pairs, whole, longest = self.found.iter if len(self.found) else lambda *_: (), self.pairs, self.whole, self.longest
        last, size = [0], [0]
        previous = ""
        for word in words:
            if MARK * 2 in word:
                yield word, self.merged(word)
                continue
            known = _shared(word, previous) + 1  # prefixes whose last piece is known
            del last[known:], size[known:]
            for end, (piece, k) in find(word, max(0, known - longest)):
                if end + 1 < known:  # decided
                    continue
                while known <= end:  # characters without piece
                    last.append(-1)
                    size.append(1)
                    known += 1
                left = last[end + 1 - k]
                if k == end + 1 or left < 0:
                    fits = whole.get(piece)
                    if fits is None:
                        fits = self._alone(piece)
                else:
                    fits = pairs.get(left << 24 | piece)
                    if fits is None:
                        fits = self._fits(left, piece)
                if fits:
                    last.append(piece)
                    size.append(k)
                    known += 1
            while known <= len(word):
                last.append(-1)
                size.append(1)
                known += 1
            previous = word
            parts, at = [], len(word)
            while at:
                parts.append(word[at - size[at] : at])
                at -= size[at]
            yield word, parts[::-1]

    def split(self, text: str) -> list[str]:
        """Marked words of a text, cut where no piece spans."""
        if not text:
            return []
        if self.normalize:
            text = self.normalize(text)
        else:
            text = (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)
        if not self.cut_marks:
            return [text]
        text = text.replace(MARK, " " + MARK)
        while MARK + " " + MARK in text:
            text = text.replace(MARK + " " + MARK, MARK + MARK)
        if self.cut_lines:
            text = text.replace("\n", " \n ")
        return text.split(" ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        split = [self.split(t or "") for t in texts]
        wanted = set().union(*split)
        missing = wanted.difference(self.words)
        if len(self.words) + len(missing) > CACHE_WORDS // 2:
            self.words, self.older, missing = {}, self.words, wanted
        for word in missing - missing.difference(self.older):
            self.words[word] = self.older[word]
        self.words[""] = b""
        for word, parts in self.walk(sorted(missing.difference(self.words))):
            self.words[word] = self._ids_of(parts)
        get = self.words.__getitem__
        return [b"".join(map(get, x)) for x in split]

    def decode(self, ids: list[int]) -> str:
        """The text that these ids stand for."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    """The model of a file, once per worker."""
    return PieceModel.load(path)


def encode_documents(docs: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, ``ids``, ``n_ids`` and ``round_trip`` (whether the ids decode to the text) for every row.

    One narrow pass; nothing is shuffled and each Arrow batch is encoded on its own.
    """
    small_batches(docs.sparkSession)
    keep = tuple(k for k in keep if k not in ("ids", "n_ids", "round_trip"))
    schema = T.StructType([docs.schema[k] for k in keep])
    schema = schema.add("ids", T.ArrayType(T.IntegerType(), False)).add("n_ids", T.LongType()).add("round_trip", T.BooleanType())

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of about ``TEXT_BYTES``, or of one longer row."""
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.column(len(keep)).nbytes
            if size > TEXT_BYTES:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = load(model)
        for batch in gathered(batches):
            texts = batch.column(len(keep)).to_pylist()
            ids = [np.frombuffer(x, dtype="<i4") for x in known.encode(texts)]
            sizes = np.asarray([len(x) for x in ids], dtype=np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32))
            same = [known.decode(x.tolist()) == (t or "") for x, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(sizes), pa.array(same, pa.bool_())], names=[*keep, "ids", "n_ids", "round_trip"])

    # Positions, not names, tell the columns apart: the text may be one of those that are kept.
    return docs.select(*keep, F.col(text).alias("text_to_encode")).mapInArrow(tidy(run, lambda: load(model).older.clear()), schema)


def decode_documents(docs: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All rows and columns with the text that the ids stand for (null ids: null)."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def text(column: pd.Series) -> pd.Series:
        known = load(model)
        return pd.Series([None if x is None else known.decode([int(i) for i in x]) for x in column])

    return docs.withColumn(out, text(F.col(ids)))
