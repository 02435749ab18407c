"""Language of a text by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a word (A-Z lower-cased; words are what white space separates) from both ends, each direction with gated recurrent units, and
gives every position the probabilities of the languages from both states. It is trained here, in numpy, by
backpropagation through time (Adam). The state starts anew with each word, so equal words have equal labels: a worker runs the network once
for each distinct word that it meets, remembers ``WORDS`` of them and adds the rest up by counts; no label is approximated by that. A word of
more than ``CUT`` bytes is read in pieces of that length. A document's probabilities are the mean over all its letter positions (a-z and bytes of other
characters); the language is the likeliest, ties to the first by code point, and ``score`` its probability.

Fitting takes at most ``PER_LANG`` documents a language and ``SAMPLE`` in all, those with the least hash of their id, and of each at most ``PER_DOC`` words at even steps
over the whole text; everything else reads whole texts. Prediction is one pass without shuffle, in groups of about ``GROUP`` words, so a text of any length is read
in pieces. Languages are drawn alike in training, however many documents they have.

A null text, and one without any letter, is ``und`` with score 0; so are all if nothing was learned. A null doc_id is not held out and not learned from. Repeated rows are
predicted alike. Other columns are kept; those named like the ones added are replaced. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import free_name, small_batches, tidy

UNKNOWN = "und"
SAMPLE, PER_LANG, PER_DOC = 4000, 300, 400
HIDDEN = 16
CUT = 32
STEPS, BATCH, RATE, SEED = 500, 768, 0.02, 7
#: Words at a time, and numbers that a worker remembers for words (languages times words).
GROUP, WORDS = 200_000, 4_000_000
#: Probabilities of a word are kept as whole numbers of this part, so that sums do not depend on the order of words.
UNIT = 1 << 16

LETTER = np.zeros(256, dtype=bool)
LETTER[ord("a") : ord("z") + 1] = True
LETTER[0x80:] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _laid(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of words as a matrix of positions by words, longest first (the caller sorts), and the lengths."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    out = np.zeros((len(words), int(sizes[0]) if len(words) else 0), dtype=np.uint8)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(words), dtype=np.uint8)
    return out.T, sizes


@dataclass
class Direction:
    """Gated recurrent units: weights of each byte (update, reset, candidate) and of the state."""

    byte: np.ndarray
    state: np.ndarray

    def run(self, laid: np.ndarray, alive: list[int], trace: list | None = None) -> np.ndarray:
        """States after each position; ``alive``: how many words reach it."""
        n = HIDDEN
        states = np.zeros((*laid.shape, n), dtype=np.float32)
        h = np.zeros((laid.shape[1], n), dtype=np.float32)
        for t, k in enumerate(alive):
            x, before = self.byte[laid[t, :k]], h[:k]
            u = before @ self.state
            gates = _sigmoid(x[:, : 2 * n] + u[:, : 2 * n])
            z, r = gates[:, :n], gates[:, n:]
            c = np.tanh(x[:, 2 * n :] + r * u[:, 2 * n :])
            after = before + z * (c - before)
            if trace is not None:
                trace.append((before.copy(), z, r, c, u[:, 2 * n :]))
            h[:k] = after
            states[t, :k] = after
        return states

    def gradient(self, laid: np.ndarray, alive: list[int], trace: list, given: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the two weights, back through time, from the gradients of the states."""
        n = HIDDEN
        d_state, steps, seen = np.zeros_like(self.state), [], []
        d = np.zeros((laid.shape[1], n), dtype=np.float32)
        for t in range(len(alive) - 1, -1, -1):
            k = alive[t]
            before, z, r, c, u = trace[t]
            dh = d[:k] + given[t, :k]
            dc = dh * z * (1 - c * c)
            dz = dh * (c - before) * z * (1 - z)
            dr = dc * u * r * (1 - r)
            inner = np.concatenate([dz, dr, dc * r], axis=1)
            d_state += before.T @ inner
            steps.append(np.concatenate([dz, dr, dc], axis=1))
            seen.append(laid[t, :k])
            d[:k] = dh * (1 - z) + inner @ self.state.T
        return _by_byte(np.concatenate(seen), np.concatenate(steps)), d_state


def _by_byte(seen: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of rows by their byte."""
    order = np.argsort(seen, kind="stable")
    found, starts = np.unique(seen[order], return_index=True)
    out = np.zeros((256, values.shape[1]), dtype=np.float32)
    out[found] = np.add.reduceat(values[order], starts, axis=0)
    return out


@dataclass
class Network:
    """Both directions and the layer that labels positions; ``langs`` in order of code points."""

    langs: list[str]
    ahead: Direction
    back: Direction
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, langs: list[str], seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda a, b, s: (rng.standard_normal((a, b)) * s).astype(np.float32)
        ways = [Direction(draw(256, 3 * HIDDEN, 0.3), draw(HIDDEN, 3 * HIDDEN, HIDDEN**-0.5)) for _ in range(2)]
        return cls(langs, *ways, draw(2 * HIDDEN, len(langs), 0.2), np.zeros(len(langs), dtype=np.float32))

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.ahead.byte, self.ahead.state, self.back.byte, self.back.state, self.out, self.bias]

    def _forward(self, words: list[bytes], traces: tuple[list | None, list | None] = (None, None)) -> tuple:
        """Words sorted longest first: what the gradient needs, and the probabilities of each position of each word."""
        laid, sizes = _laid(words)
        turned, _ = _laid([w[::-1] for w in words])
        alive = [int((sizes > t).sum()) for t in range(len(laid))]
        ahead, back = self.ahead.run(laid, alive, traces[0]), self.back.run(turned, alive, traces[1])
        t, w = np.nonzero(np.arange(len(laid))[:, None] < sizes)
        states = np.concatenate([ahead[t, w], back[sizes[w] - 1 - t, w]], axis=1)
        score = states @ self.out + self.bias
        score = np.exp(score - score.max(axis=1, keepdims=True))
        return laid, turned, alive, sizes, t, w, states, score / score.sum(axis=1, keepdims=True)

    def positions(self, word: bytes) -> np.ndarray:
        """Probabilities of the languages at each byte of a word."""
        parts = pieces_of(word)
        return np.concatenate([self._forward([p])[-1] for p in parts]) if parts else np.zeros((0, len(self.langs)), dtype=np.float32)

    def sums(self, words: list[bytes]) -> np.ndarray:
        """For each word, the probabilities added up over its letters, in whole ``UNIT`` parts."""
        out = np.zeros((len(words), len(self.langs)), dtype=np.int32)
        order = np.argsort([-len(w) for w in words], kind="stable")
        for at in range(0, len(order), 4096):
            own = order[at : at + 4096]
            laid, _, _, _, t, w, _, chances = self._forward([words[i] for i in own])
            whole = np.rint(chances * UNIT).astype(np.int32) * LETTER[laid[t, w]][:, None]
            by = np.argsort(w, kind="stable")
            found, starts = np.unique(w[by], return_index=True)
            out[own[found]] = np.add.reduceat(whole[by], starts, axis=0)
        return out

    def learn(self, words: list[bytes], langs: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean loss over the letter positions of a batch, in the order of ``weights``."""
        order = np.argsort([-len(w) for w in words], kind="stable")
        traces: tuple[list, list] = ([], [])
        laid, turned, alive, sizes, t, w, states, chances = self._forward([words[i] for i in order], traces)
        d = chances.copy()
        d[np.arange(len(d)), langs[order][w]] -= 1
        letters = LETTER[laid[t, w]]
        d *= letters[:, None] / max(1, letters.sum())
        ds = d @ self.out.T
        given = np.zeros((2, *laid.shape, HIDDEN), dtype=np.float32)
        given[0, t, w], given[1, sizes[w] - 1 - t, w] = ds[:, :HIDDEN], ds[:, HIDDEN:]
        return [*self.ahead.gradient(laid, alive, traces[0], given[0]), *self.back.gradient(turned, alive, traces[1], given[1]), states.T @ d, d.sum(axis=0)]


def pieces_of(word: bytes) -> list[bytes]:
    """A word in pieces of at most ``CUT`` bytes."""
    return [word[i : i + CUT] for i in range(0, len(word), CUT)]


def train(samples: dict[str, dict[bytes, int]], steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> Network:
    """A network from the words of each language and how often they stand."""
    langs = sorted(x for x, words in samples.items() if words)
    net = Network.fresh(langs, seed)
    if len(langs) < 2:
        return net
    rng = np.random.default_rng(seed)
    words = [sorted(samples[x]) for x in langs]
    upto = [np.cumsum([samples[x][w] for w in own], dtype=np.float64) for x, own in zip(langs, words, strict=True)]
    first = [np.zeros_like(w) for w in net.weights]
    second = [np.zeros_like(w) for w in net.weights]
    for step in range(1, steps + 1):
        which = rng.integers(len(langs), size=batch)
        at = rng.random(batch)
        drawn = [words[k][int(np.searchsorted(upto[k], a * upto[k][-1], side="right"))] for k, a in zip(which, at, strict=True)]
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for w, g, m, v in zip(net.weights, net.learn(drawn, which), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def fold_of(doc_id: Column, folds: int = 4) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string")) % folds


def training_words(docs: DataFrame, use: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE, per_lang: int = PER_LANG, per_doc: int = PER_DOC) -> dict[str, dict[bytes, int]]:
    """Words by language, with counts, of a bounded sample of the documents for which ``use`` (over ``doc_id``) holds."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    able = rows.where(use & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    # Ids are drawn without their texts; one row an id.
    ids = able.groupBy("doc_id").agg(F.min("lang").alias("lang"), F.xxhash64("doc_id").alias("h"))
    drawn = ids.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("rank") <= per_lang)
    drawn = drawn.orderBy("rank", "h", "doc_id").limit(sample).select(F.col("doc_id").alias("chosen"), F.col("lang").alias("lang2"))
    rows = able.join(F.broadcast(drawn), (F.col("doc_id") == F.col("chosen")) & (F.col("lang") == F.col("lang2")))
    one = rows.groupBy("chosen", "lang").agg(F.min("text").alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, list] = ([], [])
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = t.lower().split()
                even = [words[i * len(words) // per_doc] for i in range(per_doc)] if len(words) > per_doc else words
                parts = [p for w in even for p in pieces_of(w)[:1]]
                out[0].extend([name] * len(parts))
                out[1].extend(parts)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.binary())], names=["lang", "word"])

    words = one.select("lang", F.col("text").cast("binary")).mapInArrow(split, "lang string, word binary")
    found: dict[str, dict[bytes, int]] = {}
    for r in words.groupBy("lang", "word").agg(F.count("*").alias("n")).collect():  # SAMPLE * PER_DOC words at most
        found.setdefault(r["lang"], {})[bytes(r["word"])] = r["n"]
    return found


class Reader:
    """Adds up the labels of documents, word by word, and remembers words."""

    def __init__(self, net: Network) -> None:
        self.net, self.most = net, max(1, WORDS // max(1, len(net.langs)))
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.table = np.zeros((0, len(self.net.langs)), dtype=np.int32)

    def totals(self, texts: list[bytes]) -> np.ndarray:
        """The sum over all letter positions for each text."""
        out = np.zeros((len(texts), len(self.net.langs)), dtype=np.int64)
        held: list[tuple[int, list[bytes]]] = []
        size = 0
        for i, text in enumerate(texts if self.net.langs else ()):
            words = text.lower().split()
            if max(map(len, words), default=0) > CUT:
                words = [p for w in words for p in pieces_of(w)]
            for at in range(0, len(words), GROUP):
                held.append((i, words[at : at + GROUP]))
                size += len(held[-1][1])
                if size >= GROUP:
                    self._add(out, held)
                    held, size = [], 0
        self._add(out, held)
        return out

    def _add(self, out: np.ndarray, held: list[tuple[int, list[bytes]]]) -> None:
        wanted = set().union(*[words for _, words in held])
        if len(self.known) > self.most:
            self.forget()
        new = sorted(wanted.difference(self.known))
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.table = np.concatenate([self.table, self.net.sums(new)])
        for i, words in held:
            at = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
            out[i] += self.table[at].sum(axis=0, dtype=np.int64)


def identify(docs: DataFrame, net: Network, text: str = "text", predicted: str = "lang_pred", score: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with the language and its probability."""
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c.lower() not in (predicted.lower(), score.lower())]
    schema = T.StructType([docs.schema[c] for c in keep]).add(predicted, T.StringType(), False).add(score, T.DoubleType(), False)
    words = free_name(docs.columns, "text_to_read")
    reader = Reader(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(keep)).to_pylist()
            sums = reader.totals([t or b"" for t in texts])
            total = sums.sum(axis=1)
            best = sums.argmax(axis=1) if sums.shape[1] else np.zeros(len(texts), dtype=np.int64)
            names = [net.langs[k] if n else UNKNOWN for k, n in zip(best, total, strict=True)]
            share = [round(float(sums[i, k] / n), 6) if n else 0.0 for i, (k, n) in enumerate(zip(best, total, strict=True))]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(names, pa.string()), pa.array(share, pa.float64())], names=schema.names)

    # A text without a letter is not read: nothing of it can be labelled.
    readable = F.when(F.col(text).rlike("\\p{L}"), F.col(text).cast("binary"))
    return docs.select(*keep, readable.alias(words)).mapInArrow(tidy(run, reader.forget), schema)


def label_positions(docs: DataFrame, net: Network, text: str = "text", out: str = "labels") -> DataFrame:
    """All rows and columns with the likeliest language of every byte of the text, as its place in ``net.langs``; white space is -1 and a null text null."""
    small_batches(docs.sparkSession)

    def labels(data: bytes, known: dict[bytes, np.ndarray]) -> list[int]:
        found = np.full(len(data), -1, dtype=np.int64)
        word = ~np.isin(np.frombuffer(data, dtype=np.uint8), list(b" \t\n\v\f\r"))
        words = data.lower().split()
        known.update((w, net.positions(w).argmax(axis=1)) for w in set(words).difference(known))
        found[word] = np.concatenate([known[w] for w in words]) if words else []
        return found.tolist()

    @F.pandas_udf("array<int>")
    def label(column):
        known: dict[bytes, np.ndarray] = {}  # of one batch
        return column.map(lambda v: None if v is None else labels(v, known))

    return docs.withColumn(out, label(F.col(text).cast("binary")))
