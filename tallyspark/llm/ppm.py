"""LM scoring: prediction by partial matching over bytes.

The scored string of a text is its bytes, lower-cased (A-Z) and otherwise whole, line feeds and repeated blanks included, and one end symbol
(a byte that UTF-8 never holds; contexts at the start of a text are filled with it). The model is a trie of byte contexts
up to ``ORDER``; a symbol is coded in the longest context seen in training, or else escaped to the next shorter one. The escape
estimate of a context with q distinct among T symbols is ``ESCAPE`` * q / T, taken evenly from its symbols (method D for 0.5);
symbols of a longer context that was escaped from are
excluded from the shorter one (the code never returns to them), and what no context holds is uniform over the other bytes.

Pretrained (``score_texts``): counts come from the training documents, so what a context excludes depends on it alone and every
(context, symbol) has one fixed code length. The trie is never broadcast.

1. A training task counts words and (ORDER+1)-byte strings, and writes them sorted and packed, a row for each last pair of context bytes and
   for each of ``BUCKETS`` of words. Rows of a pair that hold more than ``MERGE_ABOVE`` strings together are merged.
2. Pairs are packed into shards of about ``SHARD_CODES`` strings, so that shards grow in number and not in size; a pair with more is
   dealt over shards by its third byte. All contexts longer than a shard's bytes lie in it; of shorter ones, orders 0 and 1 (65,792
   counts at most) and the order-2 contexts of the pairs that were dealt (256 counts each) go to every task.
3. Documents are gathered into blocks of about ``BLOCK_BYTES`` where they are read. A block's texts are written once, compressed, to a file of
   the shared folder (of its own name in every attempt), and never shuffled; beside it stand the block's questions, its distinct strings and
   words, a row a shard. Shards answer up to ``BLOCKS_A_SALT`` blocks at a time with code lengths (32-bit floats: a
   relative error below 1e-7), and a block reads its texts again and adds these up over its documents, some positions at a time.

No step holds more than a block, or a shard with the questions of ``BLOCKS_A_SALT`` blocks; results do not depend on the cutting.

Adaptive (``adaptive_scores``): the trie starts empty in every document and counts grow as it is read.

Null and empty texts have one token, the end. Repeated rows are scored each (and each counts in training). Without training
documents all bytes are equally likely and the base has only its prior. A document longer than a block is a block of its own. An empty
table gives no rows. Other columns are not carried, whatever their names.
"""

from __future__ import annotations

import itertools
import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept_table, scratch, small_batches, tidy
from .token_files import open_fs

ORDER = 6
#: What an escape takes from each distinct symbol of a context.
ESCAPE = 0.5
BLOCK_BYTES = 12 << 20
BLOCKS_A_SALT, BLOCKS_A_TASK = 256, 4
#: Strings, or words, that a shard holds, about.
SHARD_CODES = 3 << 18
#: Strings that a pair's rows hold together before they are merged; up to that, they are added up in their shards.
MERGE_ABOVE = 64 * SHARD_CODES
#: Words are dealt into these, and these to shards.
BUCKETS = 1024
END = b"\xff"
#: The end as a token of the unigram base: no word holds a line feed.
WORD_END = b"\n"
#: Positions whose codes are held at once.
SPAN = 1 << 21
#: Distinct words, and distinct strings, that a training task holds before it passes them on.
HELD_WORDS, HELD_CODES = 300_000, 4_000_000
#: Kinds of rows of counts: strings have their pair of bytes, from 0; words have WORDS - bucket.
TOKENS, LOW, WORDS = -1, -2, -3


def words_of_bytes(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words between the bytes 0x20 and 0x09 to 0x0D."""
    return (text or b"").lower().split()


def _flat(texts: list[bytes | None], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all scored strings, each after ``order`` fill bytes, and where each string starts."""
    pad, parts, lengths = END * order, [], []
    for t in texts:
        body = (t or b"").lower()
        parts += (pad, body, END)
        lengths.append(order + len(body) + 1)
    ends = np.cumsum(np.asarray(lengths, dtype=np.int64))
    return np.frombuffer(b"".join(parts), dtype=np.uint8), ends - np.asarray(lengths, dtype=np.int64) + order


def _spans(flat: np.ndarray, starts: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes (context and symbol as one integer) of some positions at a time, with these positions; fill bytes are none."""
    fill = np.zeros(len(flat) + 1, dtype=bool)
    for j in range(1, order + 1):
        fill[starts - j] = True
    for at in range(order, len(flat), SPAN):
        upto = min(at + SPAN, len(flat))
        codes = np.zeros(upto - at, dtype=np.uint64)
        for j in range(order + 1):
            codes <<= np.uint64(8)
            codes |= flat[at - order + j : upto - order + j]
        keep = ~fill[at:upto]
        yield codes[keep], np.flatnonzero(keep) + at


def _distinct(codes: np.ndarray) -> np.ndarray:
    """Sorted distinct codes (by sorting: much faster here than by hashing)."""
    s = np.sort(codes)
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def _distinct_of(flat: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    parts = [_distinct(c) for c, _ in _spans(flat, starts, order)]
    return parts[0] if len(parts) == 1 else _distinct(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint64)


class Compact:
    """Codes in few bits, with the same order: so few that a code and its place among some positions fit into 64.

    Up to 128 different bytes are numbered in their order (7 bits), and so are the different runs of three of them; a code is the numbers
    of its runs and of what is left over. With more different bytes codes stay as they are, and are sorted with an index beside them.
    """

    def __init__(self, flat: np.ndarray, starts: np.ndarray, order: int) -> None:
        self.starts, self.order = starts, order
        self.runs, self.rest = divmod(order + 1, 3)
        used = np.flatnonzero(np.bincount(flat, minlength=256))
        self.small = len(used) <= 128
        self.flat = flat
        if self.small:
            number = np.zeros(256, dtype=np.uint8)
            number[used] = np.arange(len(used))
            self.bytes, self.flat = used.astype(np.uint64), number[flat]
            seen = np.zeros(1 << 21, dtype=bool)
            for at in range(0, max(0, len(flat) - 2), SPAN):
                seen[self._grams(at, min(at + SPAN, len(flat) - 2))] = True
            self.grams = np.flatnonzero(seen)
            self.number = (np.cumsum(seen) - 1).astype(np.uint32)
            self.wide = max(1, int(len(self.grams) - 1).bit_length())
            bits = self.wide * self.runs + 7 * self.rest
            self.span = min(SPAN, 1 << max(0, 64 - bits))
            self.small = self.span >= min(SPAN, 1 << 12)
            self.flat = self.flat if self.small else flat
        if not self.small:
            self.span = SPAN

    def _grams(self, at: int, upto: int) -> np.ndarray:
        """Runs of three numbers from these positions on."""
        f = self.flat[at : upto + 2].astype(np.uint32)
        return f[:-2] << np.uint32(14) | f[1:-1] << np.uint32(7) | f[2:]

    def spans(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Codes of some positions at a time, with these positions; fill bytes are none."""
        order, flat = self.order, self.flat
        if not self.small:
            yield from _spans(flat, self.starts, order)
            return
        fill = np.zeros(len(flat) + 1, dtype=bool)
        for j in range(1, order + 1):
            fill[self.starts - j] = True
        for at in range(order, len(flat), self.span):
            upto = min(at + self.span, len(flat))
            n = upto - at
            number = self.number[self._grams(at - order, upto - order + 3 * self.runs - 3)].astype(np.uint64)
            codes = np.zeros(n, dtype=np.uint64)
            for j in range(self.runs):
                codes <<= np.uint64(self.wide)
                codes |= number[3 * j : 3 * j + n]
            for j in range(3 * self.runs, order + 1):
                codes <<= np.uint64(7)
                codes |= flat[at - order + j : upto - order + j]
            keep = ~fill[at:upto]
            yield codes[keep], np.flatnonzero(keep) + at

    def distinct(self) -> np.ndarray:
        parts = [_distinct(c) for c, _ in self.spans()]
        return parts[0] if len(parts) == 1 else _distinct(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint64)

    def widen(self, codes: np.ndarray) -> np.ndarray:
        """The codes as bytes."""
        if not self.small:
            return codes
        parts = []
        for j in range(self.rest):
            parts.append(self.bytes[((codes >> np.uint64(7 * j)) & np.uint64(127)).astype(np.int64)])
        left = codes >> np.uint64(7 * self.rest)
        for j in range(self.runs):
            gram = self.grams[((left >> np.uint64(self.wide * j)) & np.uint64((1 << self.wide) - 1)).astype(np.int64)]
            parts += [self.bytes[gram >> k & 127] for k in (0, 7, 14)]
        out = np.zeros(len(codes), dtype=np.uint64)
        for j, part in enumerate(parts):
            out |= part << np.uint64(8 * j)
        return out

    def look_up(self, codes: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The value of each code of a span among sorted keys that hold all of them: sorted first, so that neighbours look up neighbours."""
        if self.small:
            bits = np.uint64(max(1, int(self.span - 1).bit_length()))
            s = np.sort(codes << bits | np.arange(len(codes), dtype=np.uint64))
            order = (s & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
            s >>= bits
        else:
            order = np.argsort(codes)
            s = codes[order]
        first = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, dtype=bool)
        out = np.empty(len(codes))
        out[order] = values[np.searchsorted(keys, s[first])][np.cumsum(first) - 1]
        return out


def _planes(x: np.ndarray) -> bytes:
    """Numbers compressed with their byte planes apart."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def _numbers(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _pack(codes: np.ndarray) -> bytes:
    """Sorted codes as compressed differences."""
    return _planes(np.diff(codes, prepend=np.uint64(0)))


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(_numbers(data, np.uint64), dtype=np.uint64)


def _pair(codes: np.ndarray) -> np.ndarray:
    """The last two context bytes."""
    return ((codes >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int64)


class Deal:
    """Which shard holds which strings: by the last two context bytes, and where these have too many strings, by the third too."""

    def __init__(self, sizes: dict[int, int], words: int, limit: int) -> None:
        self.words = min(BUCKETS, max(8, -(-words // limit)))  # shards of words come first
        self.first, self.parts = np.zeros(1 << 16, dtype=np.int64), np.ones(1 << 16, dtype=np.int64)
        n, held = self.words, 0
        for pair, size in sorted(sizes.items()):
            if size > limit:
                continue
            if held and held + size > limit:
                n, held = n + 1, 0
            self.first[pair] = n
            held += size
        n += 1
        self.split = sorted(p for p, size in sizes.items() if size > limit)
        for pair in self.split:
            self.first[pair], self.parts[pair] = n, min(256, -(-sizes[pair] // limit))
            n += self.parts[pair]
        self.shards = int(n)

    def of(self, codes: np.ndarray) -> np.ndarray:
        """The shard of each code; pairs that training never saw share the first one of strings."""
        pair = _pair(codes)
        third = ((codes >> np.uint64(24)) & np.uint64(0xFF)).astype(np.int64)
        return np.maximum(self.first[pair], self.words) + third * 167 % 256 * self.parts[pair] // 256

    def of_bucket(self, bucket: int) -> int:
        """The shard of a bucket of words."""
        return bucket * self.words // BUCKETS


def _bucket(word: bytes) -> int:
    return zlib.crc32(word) % BUCKETS


def _pack_words(words: list[bytes]) -> bytes:
    """Words, none of which holds a blank."""
    return zstandard.compress(b" ".join(words), 3)


def _unpack_words(data: bytes) -> list[bytes]:
    return zstandard.decompress(data).split(b" ")


def _pack_floats(x: np.ndarray) -> bytes:
    """32-bit floats as places in the list of the different ones, which are few, and that list by its differences."""
    kinds, places = np.unique(x, return_inverse=True)
    packed = _planes(np.diff(kinds.view(np.uint32), prepend=np.uint32(0)))
    return len(kinds).to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed + _planes(places.astype(np.uint16 if len(kinds) <= 1 << 16 else np.uint32))


def _unpack_floats(data: bytes) -> np.ndarray:
    n, size = (int.from_bytes(data[i : i + 4], "little") for i in (0, 4))
    kinds = np.cumsum(_numbers(data[8 : 8 + size], np.uint32), dtype=np.uint32).view(np.float32)
    return kinds[_numbers(data[8 + size :], np.uint16 if n <= 1 << 16 else np.uint32)]


def _add(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two tables of sorted codes and counts as one."""
    codes = _distinct(np.concatenate([a[0], b[0]]))
    n = np.zeros(len(codes), dtype=np.int64)
    for keys, counts in (a, b):
        n[np.searchsorted(codes, keys)] += counts
    return codes, n


def _sum_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Tables of sorted codes and counts as one, by halves."""
    while len(parts) > 1:
        parts = [_add(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))


_COUNTS = "pair int, key binary, codes binary, counts binary, n long"
_COUNT_NAMES = ["pair", "key", "codes", "counts", "n"]


def _count_rows(pairs: list[int], keys: list[bytes | None], codes: list[bytes | None], counts: list[bytes | None], n: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pairs, pa.int32()), pa.array(keys, pa.binary()), pa.array(codes, pa.binary()), pa.array(counts, pa.binary()), pa.array(n, pa.int64())], names=_COUNT_NAMES)


def _by_pair(codes: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Sorted codes and counts for each pair of last context bytes."""
    pair = _pair(codes)
    order = np.argsort(pair, kind="stable")
    pair, codes, n = pair[order], codes[order], n[order]
    cuts = [*np.flatnonzero(np.diff(pair, prepend=-1)).tolist(), len(pair)]
    for at, upto in zip(cuts, cuts[1:], strict=False):
        yield int(pair[at]), codes[at:upto], n[at:upto]


def train_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``pair, key, codes, counts, n``: partial counts of words (and ends), of pairs of bytes, and of (order+1)-byte strings in the column ``t`` (binary).

    Words and strings are packed, with their number in ``n``; ``TOKENS`` rows have the number of all words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        codes, new = _sum_up([]), []
        low = np.zeros(1 << 16, dtype=np.int64)

        def merge() -> None:
            nonlocal codes, new
            if new:
                codes = _add(codes, np.unique(np.concatenate(new), return_counts=True))
            new = []

        def word_rows() -> Iterator[pa.RecordBatch]:
            by: dict[int, list[bytes]] = {}
            for w in sorted(words):
                by.setdefault(_bucket(w), []).append(w)
            if by:
                n = [np.asarray([words[w] for w in own], dtype=np.int64) for own in by.values()]
                yield _count_rows([TOKENS, *[WORDS - k for k in by]], [None] * (len(by) + 1), [None, *map(_pack_words, by.values())], [None, *map(_planes, n)], [sum(words.values()), *map(len, by.values())])
            words.clear()

        def string_rows() -> Iterator[pa.RecordBatch]:
            nonlocal codes
            merge()
            parts = list(_by_pair(*codes))
            for i in range(0, len(parts), 512):
                some = parts[i : i + 512]
                yield _count_rows([p for p, _, _ in some], [None] * len(some), [_pack(c) for _, c, _ in some], [_planes(n) for _, _, n in some], [len(c) for _, c, _ in some])
            codes = _sum_up([])

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for t in texts:
                words.update(words_of_bytes(t))
            words[WORD_END] += len(texts)
            flat, starts = _flat(texts, order)
            for c, _ in _spans(flat, starts, order):
                new.append(c)
                low += np.bincount((c & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16)
                if sum(map(len, new)) > 3 << 20:
                    merge()
                if len(codes[0]) > HELD_CODES:
                    yield from string_rows()
            if len(words) > HELD_WORDS:
                yield from word_rows()
        yield from word_rows()
        yield from string_rows()
        seen = np.flatnonzero(low)
        yield _count_rows([LOW] * len(seen), [bytes([x >> 8, x & 255]) for x in seen.tolist()], [None] * len(seen), [None] * len(seen), low[seen].tolist())

    return docs.mapInArrow(tidy(count), _COUNTS)


def merged_counts(packed: DataFrame, most: int = MERGE_ABOVE, share: int = MERGE_ABOVE // 8) -> tuple[DataFrame, dict[int, int]]:
    """Rows of strings, those of a pair merged where they hold more than ``most`` strings, about ``share`` in a task, until they do not or are hardly fewer.

    With the strings of each pair (65,536 at most).
    """

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        codes, n = _sum_up([(_unpack(c), _numbers(k, np.int64)) for c, k in zip(rows.column("codes").to_pylist(), rows.column("counts").to_pylist(), strict=True)])
        return pa.Table.from_batches([_count_rows([key[0].as_py()], [None], [_pack(codes)], [_planes(n)], [len(codes)])])

    while True:
        sizes = {r["pair"]: (r["n"], r["k"]) for r in packed.groupBy("pair").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect()}
        groups = {p: -(-n // share) for p, (n, k) in sizes.items() if n > most and k > -(-n // share)}
        if not groups:
            return packed, {p: n for p, (n, _) in sizes.items()}
        fan = F.element_at(F.create_map(*[F.lit(x) for pair in groups.items() for x in pair]), F.col("pair"))
        told = packed.withColumn("fan", fan).withColumn("group", F.pmod(F.xxhash64("codes"), F.coalesce("fan", F.lit(1))))
        new = kept_table(told.where("fan is not null").select("pair", "group", *_COUNT_NAMES[1:]).groupBy("pair", "group").applyInArrow(merge, _COUNTS), "merged")
        packed = told.where("fan is null").select(*_COUNT_NAMES).unionByName(new)
        after = new.agg(F.sum("n").alias("n")).first()["n"]
        if after > 0.8 * sum(sizes[p][0] for p in groups):
            return packed, {r["pair"]: r["n"] for r in packed.groupBy("pair").agg(F.sum("n").alias("n")).collect()}


def low_orders(counts: DataFrame) -> np.ndarray:
    """Counts of (one context byte, symbol): a 256 x 256 table, whatever the size of the corpus."""
    out = np.zeros((256, 256), dtype=np.int64)
    for r in counts.where(F.col("pair") == LOW).groupBy("key").agg(F.sum("n").alias("n")).collect():
        out[r["key"][0], r["key"][1]] = r["n"]
    return out


def pair_orders(packed: DataFrame, pairs: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of (two context bytes, symbol) for some pairs: 256 at most for each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keys, back = np.unique(_unpack(c) & np.uint64(0xFFFFFF), return_inverse=True)
                n = np.bincount(back, weights=_numbers(k, np.int64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], names=["code", "n"])

    if not pairs:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    found = packed.where(F.col("pair").isin(pairs)).select("codes", "counts").mapInArrow(cut, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()
    return np.asarray([r["code"] for r in found], dtype=np.uint64), np.asarray([r["n"] for r in found], dtype=np.int64)


class Trie:
    """Code lengths of one shard: all contexts that end in its bytes, over the given lower orders.

    ``known``: the order-2 codes and counts of pairs of which the shard holds a part only.
    """

    def __init__(self, codes: np.ndarray, n: np.ndarray, low: np.ndarray, order: int = ORDER, known: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        self.order, self.low = order, low
        self.levels = []
        sort = np.argsort(codes)
        codes, n = codes[sort], n[sort].astype(np.float64)
        below: tuple | None = None
        for k in range(0, order + 1):
            if k < 2:
                full = low if k else low.sum(axis=0, keepdims=True)
                keys = np.flatnonzero(full).astype(np.uint64)
                counts = full.reshape(-1)[keys.astype(np.int64)].astype(np.float64)
            else:
                cut = codes & np.uint64((1 << 8 * (k + 1)) - 1)
                keys, back = np.unique(cut, return_inverse=True)
                counts = np.bincount(back, weights=n, minlength=len(keys))
                if k == 2 and known is not None and len(known[0]):
                    whole = ~np.isin(keys >> np.uint64(8), known[0] >> np.uint64(8))
                    keys, counts = np.concatenate([keys[whole], known[0]]), np.concatenate([counts[whole], known[1].astype(np.float64)])
                    sort = np.argsort(keys)
                    keys, counts = keys[sort], counts[sort]
            contexts, own = np.unique(keys >> np.uint64(8), return_inverse=True)
            total = np.bincount(own, weights=counts, minlength=len(contexts))
            kinds = np.bincount(own, minlength=len(contexts)).astype(np.float64)
            out = np.zeros(len(contexts))
            if below is not None and len(keys):
                # What this context excludes one order below: the counts there of the symbols it holds.
                at = np.searchsorted(below[0], keys & np.uint64((1 << 8 * k) - 1))
                out = np.bincount(own, weights=below[1][at], minlength=len(contexts))
            self.levels.append((keys, counts, contexts, total, kinds, out))
            below = keys, counts

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 of the probability of the last byte of each code after the others."""
        p = np.zeros(len(codes))
        todo = np.arange(len(codes))
        out, gone = np.zeros(len(codes)), np.zeros(len(codes))
        for k in range(self.order, -1, -1):
            keys, counts, contexts, total, kinds, excluded = self.levels[k]
            if not len(keys) or not len(todo):
                continue
            cut = codes[todo] & np.uint64((1 << 8 * (k + 1)) - 1)
            at = np.minimum(np.searchsorted(contexts, cut >> np.uint64(8)), len(contexts) - 1)
            seen = contexts[at] == cut >> np.uint64(8)
            left = kinds[at] - gone[todo]
            whole = total[at] - out[todo]
            here = np.minimum(np.searchsorted(keys, cut), len(keys) - 1)
            hit = seen & (keys[here] == cut)
            p[todo[hit]] += np.log10((counts[here[hit]] - ESCAPE) / whole[hit])
            miss = seen & ~hit & (left > 0)
            p[todo[miss]] += np.log10(ESCAPE * left[miss] / whole[miss])
            now = seen & ~hit
            out[todo[now]], gone[todo[now]] = excluded[at[now]], kinds[at[now]]
            todo = todo[~hit]
        kinds = self.levels[0][4]
        p[todo] -= math.log10(256 - (kinds[0] if len(kinds) else 0))
        return p


_ASKED = "block long, shard int, asked binary, ids array<long>, held array<boolean>, sizes array<int>"
_ASKED_NAMES = ["block", "shard", "asked", "ids", "held", "sizes"]
#: The shard number of a block's texts, whose row names their file.
TEXTS = -1


def _words_by_shard(texts: list[bytes | None], deal: Deal) -> list[list[bytes]]:
    """The distinct words (and the end) of some texts in order, for each shard of words."""
    by: list[list[bytes]] = [[] for _ in range(deal.words)]
    for w in sorted(set().union(*map(words_of_bytes, texts)) | {WORD_END}):
        by[deal.of_bucket(_bucket(w))].append(w)
    return by


def _questions(order: int, deal: Deal, block_bytes: int, folder: str):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents (doc_id, held_out, t) as blocks: a row with the file of the texts, and one for each shard with what is asked of it, in order."""
        part, n = TaskContext.get().partitionId() if TaskContext.get() else 0, 0
        fs, path = open_fs(folder)
        fs.create_dir(path, recursive=True)
        ids: list[int | None] = []
        held: list[bool] = []
        texts: list[bytes | None] = []
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            block = (part << 32) + n
            name = f"{block}-{uuid.uuid4().hex}"
            # Every shard of words is asked, if for nothing, since all of them tell how many words there are.
            asked = [(TEXTS, name.encode()), *((k, _pack_words(w)) for k, w in enumerate(_words_by_shard(texts, deal)))]
            body = zstandard.compress(b"".join(t or b"" for t in texts), 3)
            with fs.open_output_stream(f"{path}/{name}") as out:  # the texts, and the words in the order asked
                out.write(b"".join([len(body).to_bytes(8, "little"), body, *(len(w).to_bytes(8, "little") + w for k, w in asked[1:])]))
            every = _distinct_of(*_flat(texts, order), order)
            shards = deal.of(every)
            sort = np.argsort(shards, kind="stable")
            cuts = [*np.flatnonzero(np.diff(shards[sort], prepend=-1)).tolist(), len(sort)]
            asked += [(int(shards[sort[a]]), _pack(every[sort[a:b]])) for a, b in zip(cuts, cuts[1:], strict=False)]
            none = [None] * (len(asked) - 1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block] * len(asked), pa.int64()),
                    pa.array([k for k, _ in asked], pa.int32()),
                    pa.array([x for _, x in asked], pa.binary()),
                    pa.array([ids, *none], pa.list_(pa.int64())),
                    pa.array([held, *none], pa.list_(pa.bool_())),
                    pa.array([[len(t or b"") for t in texts], *none], pa.list_(pa.int32())),
                ],
                names=_ASKED_NAMES,
            )

        for batch in batches:
            for i, h, t in zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True):
                if texts and size + len(t or b"") > block_bytes:
                    yield from rows()
                    ids, held, texts, size, n = [], [], [], 0, n + 1
                ids.append(i)
                held.append(h)
                texts.append(t)
                size += len(t or b"")
        if texts:
            yield from rows()

    return ask


def _answers(low: np.ndarray, order: int, deal: Deal, known: tuple[np.ndarray, np.ndarray]):
    def answer(model: pa.Table, asked: pa.Table) -> pa.Table:
        """The counts of the words, or the code lengths of the strings, in the order asked; ``kinds``: words of the shard."""
        out, shards, blocks, kinds = [], asked.column("shard").to_pylist(), asked.column("block").to_pylist(), 0
        parts = zip(model.column("codes").to_pylist(), model.column("counts").to_pylist(), strict=True)
        if not shards:
            pass
        elif shards[0] < deal.words:
            n: Counter = Counter()
            for c, k in parts:
                for w, x in zip(_unpack_words(c), _numbers(k, np.int64).tolist(), strict=True):
                    n[w] += x
            kinds = len(n)
            for x in asked.column("asked"):
                keys = _unpack_words(x.as_py())
                out.append(_planes(np.fromiter((n.get(k, 0) for k in keys), dtype=np.int64, count=len(keys))))
        else:
            codes, n = _sum_up([(_unpack(c), _numbers(k, np.int64)) for c, k in parts])
            trie = Trie(codes, n, low, order, known)
            for x in asked.column("asked"):
                out.append(_pack_floats(trie.log10(_unpack(x.as_py())).astype(np.float32)))
        return pa.table({"block": pa.array(blocks, pa.int64()), "shard": pa.array(shards, pa.int32()), "answer": pa.array(out, pa.binary()), "kinds": pa.array([kinds] * len(shards), pa.int64())})

    return answer


def _routes(deal: Deal):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of strings and words with their shard; rows of a pair that was dealt are cut."""
        for b in batches:
            shards, codes, counts = [], [], []
            for p, c, k in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                if p <= WORDS:
                    shards.append(deal.of_bucket(WORDS - p))
                    codes.append(c)
                    counts.append(k)
                    continue
                if deal.parts[p] == 1:
                    shards.append(int(max(deal.first[p], deal.words)))
                    codes.append(c)
                    counts.append(k)
                    continue
                every, n = _unpack(c), _numbers(k, np.int64)
                to = deal.of(every)
                for s in np.unique(to):
                    shards.append(int(s))
                    codes.append(_pack(every[to == s]))
                    counts.append(_planes(n[to == s]))
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(codes, pa.binary()), pa.array(counts, pa.binary())], names=["shard", "codes", "counts"])

    return route


def _sums(order: int, tokens: int, deal: Deal, folder: str):
    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        """Scores of a block's documents from the answers to its questions."""
        shards_ = answers.column("shard").to_pylist()
        got = dict(zip(shards_, answers.column("answer").to_pylist(), strict=True))
        den = tokens + 0.5 * (sum(n for k, n in zip(shards_, answers.column("kinds").to_pylist(), strict=True) if k < deal.words) + 1)
        fs, path = open_fs(folder)
        with fs.open_input_stream(f"{path}/{docs.column('asked')[0].as_py().decode()}") as file:
            parts = [zstandard.decompress(file.read(int.from_bytes(file.read(8), "little"))) for _ in range(1 + deal.words)]
        at, texts = 0, []
        for n in docs.column("sizes")[0].as_py():
            texts.append(parts[0][at : at + n])
            at += n
        place: dict[bytes, int] = {}
        counts = []
        for k, own in enumerate(parts[1:]):
            if own:
                place.update(zip(own.split(b" "), itertools.count(len(place))))
                counts.append(_numbers(got[k], np.int64))
        count = np.concatenate(counts)
        n_tokens, flat_words = [], []
        for t in texts:
            words = words_of_bytes(t)
            n_tokens.append(len(words) + 1)
            flat_words.append(np.fromiter(map(place.__getitem__, words), dtype=np.int32, count=len(words)))
            flat_words.append(np.asarray([place[WORD_END]], dtype=np.int32))
        token, first = np.concatenate(flat_words), np.cumsum(n_tokens) - n_tokens
        log = np.log10((count + 0.5) / den)
        base, n_known = np.add.reduceat(log[token], first), np.add.reduceat((count > 0).astype(np.int64)[token], first)
        del place, parts, flat_words, token

        flat, starts = _flat(texts, order)
        compact = Compact(flat, starts, order)
        del flat
        keys = compact.distinct()
        shards, p = deal.of(compact.widen(keys)), np.zeros(len(keys))
        for k in np.unique(shards):
            p[shards == k] = _unpack_floats(got[int(k)])
        total = np.zeros(len(texts))
        for c, places in compact.spans():
            found = compact.look_up(c, keys, p)
            cuts = np.searchsorted(places, starts)
            one = max(0, int(np.searchsorted(starts, places[0], side="right")) - 1) if len(places) else 0
            own = np.arange(one, int(np.searchsorted(starts, places[-1], side="right"))) if len(places) else np.zeros(0, dtype=np.int64)
            total[own] += np.add.reduceat(found, cuts[own]) if len(own) else 0.0
        return pa.table(
            {
                "doc_id": pa.array(docs.column("ids")[0].as_py(), pa.int64()),
                "held_out": pa.array(docs.column("held")[0].as_py(), pa.bool_()),
                "n_tokens": pa.array(n_tokens, pa.int64()),
                "n_known": pa.array(n_known, pa.int64()),
                "train_tokens": pa.array([tokens] * len(texts), pa.int64()),
                "base_score": pa.array(base, pa.float64()),
                "score": pa.array(total),
            }
        )

    return score


def held_out(doc_id: Column, fold: int = 1, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` (null ids: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def score_texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", order: int = ORDER, block_bytes: int = BLOCK_BYTES, shard_codes: int = SHARD_CODES) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigrams) and score (PPM), both log10.

    Learns from the documents that are not held out.
    """
    if not 2 <= order <= 7:
        raise ValueError("order must be 2 to 7: a context and its symbol are one 64-bit code")
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).cast("binary").alias("t"))
    counts = kept_table(train_counts(rows.where("not held_out").select("t"), order), "counts")
    low = low_orders(counts)
    sums = counts.agg(F.sum(F.when(F.col("pair") == TOKENS, F.col("n"))).alias("tokens"), F.sum(F.when(F.col("pair") <= WORDS, F.col("n"))).alias("words")).first()
    packed, sizes = merged_counts(counts.where("pair >= 0"), 64 * shard_codes, 8 * shard_codes)
    deal = Deal(sizes, sums["words"] or 0, shard_codes)
    known = pair_orders(packed, deal.split)
    folder = scratch(spark, "texts")
    asked = kept_table(rows.select("doc_id", "held_out", "t").mapInArrow(tidy(_questions(order, deal, block_bytes, folder)), _ASKED), "asked")
    texts = asked.where(F.col("shard") == TEXTS)
    blocks = texts.count()
    salts = max(1, -(-blocks // BLOCKS_A_SALT))
    model = packed.unionByName(counts.where(F.col("pair") <= WORDS)).select("pair", "codes", "counts").mapInArrow(_routes(deal), "shard int, codes binary, counts binary")
    model = model.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    questions = asked.where(F.col("shard") != TEXTS).select("block", "shard", "asked", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"))
    answers = model.groupBy("shard", "salt").cogroup(questions.groupBy("shard", "salt")).applyInArrow(_answers(low, order, deal, known), "block long, shard int, answer binary, kinds long")
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    # As many tasks as there are blocks ask for: a task's answers do not grow with the corpus.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks // BLOCKS_A_TASK)
    return texts.repartition(tasks, "block").groupBy("block").cogroup(answers.repartition(tasks, "block").groupBy("block")).applyInArrow(_sums(order, sums["tokens"] or 0, deal, folder), out)


def adaptive_log10(text: bytes | None, order: int = ORDER) -> float:
    """log10 of the probability of a text under a trie that starts empty and counts as it goes."""
    data = END * order + (text or b"").lower() + END
    seen: dict[bytes, dict[int, int]] = {}
    total = 0.0
    for i in range(order, len(data)):
        symbol, excluded = data[i], set()
        for k in range(order, -1, -1):
            counts = seen.get(data[i - k : i])
            if not counts:
                continue
            open_ = {s: n for s, n in counts.items() if s not in excluded}
            if not open_:
                continue
            whole = sum(open_.values())
            if symbol in open_:
                total += math.log10((open_[symbol] - ESCAPE) / whole)
                break
            total += math.log10(ESCAPE * len(open_) / whole)
            excluded |= open_.keys()
        else:
            total -= math.log10(256 - len(excluded))
        for k in range(order + 1):
            at = seen.setdefault(data[i - k : i], {})
            at[symbol] = at.get(symbol, 0) + 1
    return total


def adaptive_scores(docs: DataFrame, text: str = "text", out: str = "adaptive_score", order: int = ORDER) -> DataFrame:
    """All rows and columns with the adaptive score of their text."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([adaptive_log10(None if x is None else x.encode(), order) for x in texts])

    return docs.withColumn(out, score(F.col(text)))
