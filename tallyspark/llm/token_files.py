"""Token ids in fixed-width binary files.

A file holds the ids of many documents in the least bits that the vocabulary needs (16 bits for 49,408 ids), in blocks of
``BLOCK`` ids that each start at a byte. Layout, little-endian:

    blocks    ids packed most significant bit first, each block padded to a whole byte
    offsets   (blocks + 1) x Q: byte at which each block starts, and where the last ends
    docs      documents x (B known, q doc_id, Q first id, Q ids)
    footer    8s magic, I bits, I ids a block, Q ids, Q blocks, Q documents, Q byte at which offsets start, 8s magic

Any range of ids is read by looking up its blocks in ``offsets``, reading these bytes and unpacking them with numpy.

``write_token_files`` sorts documents by doc_id over range partitions and writes one file per partition through the
filesystem of the target URI (local, HDFS, S3: what pyarrow opens). Every task attempt writes a file of its own name; only
names in the committed manifest count, so a lost executor leaves at most an unused file. ``read_token_files`` reads the
files back, one task per file, a bounded number of ids at a time.

Null and empty texts have only the end id. Equal doc_ids are ordered by a hash of their text; null ids come first.
An empty table gives no rows.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import kept_table, small_batches

MAGIC = b"FWTOKEN1"
FOOTER = struct.Struct("<8sIIQQQ")
TRAILER = struct.Struct("<Q8s")
DOC = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("first", "<u8"), ("n", "<u8")])
BLOCK = 1 << 16
#: Words whose ids a worker remembers before it starts afresh.
CACHE_WORDS = 1_200_000
#: Ids that a reader unpacks at once, unless one document has more.
READ_IDS = 1 << 21


def width_of(vocabulary: int) -> int:
    """Bits for ids 0..vocabulary-1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids at ``bits`` bits each, most significant first, padded to a byte."""
    ids = np.ascontiguousarray(ids, dtype=">u4")
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    spread = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - bits :]
    return np.packbits(spread.reshape(-1)).tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids of a packed block."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f">u{bits // 8}", count=n).astype("<u4")
    flat = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 32), dtype=np.uint8)
    wide[:, 32 - bits :] = flat
    return np.packbits(wide, axis=1).view(">u4").reshape(-1).astype("<u4")


def open_fs(uri: str):
    """pyarrow filesystem and path of a URI or a plain local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)


class Writer:
    """Appends documents to one file."""

    def __init__(self, uri: str, bits: int, block: int = BLOCK) -> None:
        self.fs, self.path = open_fs(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.bits, self.block = bits, block
        self.out = self.fs.open_output_stream(self.path)
        self.at, self.ids, self.pending, self.held = 0, 0, [], 0
        self.offsets: list[int] = []
        self.docs: list[np.ndarray] = []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_ids: list, ids: list[np.ndarray]) -> None:
        """Documents with their ids, in order."""
        rows = np.zeros(len(doc_ids), dtype=DOC)
        lengths = np.fromiter((len(x) for x in ids), dtype=np.uint64, count=len(ids))
        rows["known"] = [x is not None for x in doc_ids]
        rows["doc_id"] = [0 if x is None else x for x in doc_ids]
        rows["n"] = lengths
        rows["first"] = np.uint64(self.ids) + np.cumsum(lengths) - lengths
        self.docs.append(rows)
        self.ids += int(lengths.sum())
        self.pending += ids
        self.held += int(lengths.sum())
        if self.held >= self.block:
            flat = np.concatenate(self.pending)
            for i in range(0, len(flat) - self.block + 1, self.block):
                self._block(flat[i : i + self.block])
            rest = flat[len(flat) // self.block * self.block :]
            self.pending, self.held = [rest], len(rest)

    def _block(self, ids: np.ndarray) -> None:
        self.offsets.append(self.at)
        self._put(pack(ids, self.bits))

    def close(self) -> tuple[int, int]:
        """Writes the tables; documents and ids in the file."""
        if self.held:
            self._block(np.concatenate(self.pending))
        self.offsets.append(self.at)
        start = self.at
        docs = np.concatenate(self.docs) if self.docs else np.zeros(0, dtype=DOC)
        self._put(np.asarray(self.offsets, dtype="<u8").tobytes())
        self._put(docs.tobytes())
        self._put(FOOTER.pack(MAGIC, self.bits, self.block, self.ids, len(self.offsets) - 1, len(docs)))
        self._put(TRAILER.pack(start, MAGIC))
        self.out.close()
        return len(docs), self.ids


class Reader:
    """Random access to one file."""

    def __init__(self, uri: str) -> None:
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        end = self.file.size()
        tail = self._read(end - TRAILER.size - FOOTER.size, TRAILER.size + FOOTER.size)
        magic, self.bits, self.block, self.n_ids, self.n_blocks, self.n_docs = FOOTER.unpack(tail[: FOOTER.size])
        start, again = TRAILER.unpack(tail[FOOTER.size :])
        if magic != MAGIC or again != MAGIC:
            raise ValueError(f"{uri} is no token file")
        self.offsets = np.frombuffer(self._read(start, 8 * (self.n_blocks + 1)), dtype="<u8").astype(np.int64)
        self.docs_at = start + 8 * (self.n_blocks + 1)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def docs(self, first: int, n: int) -> np.ndarray:
        """Rows ``first`` to ``first + n`` of the document table."""
        n = max(0, min(n, self.n_docs - first))
        return np.frombuffer(self._read(self.docs_at + first * DOC.itemsize, n * DOC.itemsize), dtype=DOC)

    def ids(self, first: int, n: int) -> np.ndarray:
        """Ids ``first`` to ``first + n``: only their blocks are read."""
        if not n:
            return np.zeros(0, dtype="<u4")
        a, b = first // self.block, (first + n - 1) // self.block
        data = self._read(int(self.offsets[a]), int(self.offsets[b + 1] - self.offsets[a]))
        parts = []
        for k in range(a, b + 1):
            own = data[self.offsets[k] - self.offsets[a] : self.offsets[k + 1] - self.offsets[a]]
            parts.append(unpack(own, min(self.block, self.n_ids - k * self.block), self.bits))
        return np.concatenate(parts)[first - a * self.block : first - a * self.block + n]

    def close(self) -> None:
        self.file.close()


_encoders: dict[str, Encoder] = {}
#: The white space at which the tokenizer may be split without changing its ids: it drops white space and merges nothing across.
_BLANKS = "\t\n\x0b\x0c\r"
#: Marks that this tokenizer sets apart from letters before them.
_MARKS = ".,"
_JOINED = 500


class Encoder:
    """A tokenizer whose ids of a text are those of its space-separated runs in turn, each encoded once and remembered.

    That holds for tokenizers that drop white space and never join across it. Runs of letters (but for the capital sigma, whose lower case depends on its place), perhaps with one mark at the
    end, are encoded many to a call: the ids that end a word show where each run ends, and if their number is not
    that of the runs, the call is repeated run by run.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.runs: dict[str, bytes] = {}
        self.letters: dict[str, bytes] = {}
        self.marks = {m: self._ids(m) for m in _MARKS} | {"": b""}

    def _ids(self, run: str) -> bytes:
        return np.asarray(self.tokenizer.encode(run, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _letters(self, words: list[str]) -> None:
        calls = [words[i : i + _JOINED] for i in range(0, len(words), _JOINED)]
        for own, found in zip(calls, self.tokenizer.encode_batch_fast([" ".join(x) for x in calls], add_special_tokens=False), strict=True):
            ids = np.asarray(found.ids, dtype="<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cuts) != len(own):
                self.letters.update((w, self._ids(w)) for w in own)
                continue
            data, at = ids.tobytes(), 0
            for w, cut in zip(own, cuts.tolist(), strict=True):
                self.letters[w] = data[at:cut]
                at = cut

    def _add(self, runs: set[str]) -> None:
        plain, rest = [], []
        for run in runs:
            core = run[:-1] if run and run[-1] in _MARKS else run
            low = core.lower()
            (plain if core.isalpha() and low.isalpha() and len(low) == len(core) and "Σ" not in core else rest).append((run, low, run[len(core) :]))
        self._letters(list({low for _, low, _ in plain}.difference(self.letters)))
        self.runs.update((run, self.letters[low] + self.marks[mark]) for run, low, mark in plain)
        names = [run for run, _, _ in rest]
        for i in range(0, len(names), 4096):
            part = names[i : i + 4096]
            for run, found in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.runs[run] = np.asarray(found.ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        split = []
        for text in texts:
            for blank in _BLANKS:
                text = text.replace(blank, " ")
            split.append(text.split(" "))
        missing = set().union(*split).difference(self.runs)
        if len(self.runs) + len(missing) > CACHE_WORDS:
            self.runs.clear()
            self.letters.clear()
            missing = set().union(*split)
        self._add(missing)
        get = self.runs.__getitem__
        return [b"".join(map(get, x)) for x in split]


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as little-endian 32-bit integers, with one encoder per worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path].encode(texts)


def vocabulary_of(path: str) -> int:
    """Ids that the tokenizer of this file has."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def write_token_files(docs: DataFrame, uri: str, tokenizer: str, end_id: int = 1, text: str = "text", doc_id: str = "doc_id", files: int | None = None) -> DataFrame:
    """Writes all documents in ascending doc_id order under ``uri``; returns the manifest (file, uri, n_docs, n_ids, first_id).

    ``first_id`` is the number of ids in all files before. ``files`` defaults to the session's shuffle partitions.
    """
    spark = docs.sparkSession
    small_batches(spark)
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = width_of(max(vocabulary_of(tokenizer), end_id + 1))
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        where = f"{uri}/part-{part:07d}-{uuid.uuid4().hex}.ids"
        writer = None
        for batch in batches:
            if not batch.num_rows:
                continue
            writer = writer or Writer(where, bits)
            packed = encode_texts([x or "" for x in batch.column(1).to_pylist()], tokenizer)
            writer.add(batch.column(0).to_pylist(), [np.frombuffer(x + end, dtype="<u4") for x in packed])
        if writer:
            n_docs, n_ids = writer.close()
            yield pa.RecordBatch.from_pydict({"file": pa.array([part], pa.int64()), "uri": [where], "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).withColumn("h", F.xxhash64("t"))
    rows = rows.repartitionByRange(files, F.col("d").asc_nulls_first(), F.col("h").asc()).sortWithinPartitions(F.col("d").asc_nulls_first(), F.col("h").asc()).select("d", "t")
    manifest = kept_table(rows.mapInArrow(write, "file long, uri string, n_docs long, n_ids long"), "manifest")
    before = Window.partitionBy().orderBy("file").rowsBetween(Window.unboundedPreceding, 0)
    return manifest.withColumn("first_id", F.sum("n_ids").over(before) - F.col("n_ids"))


def read_documents(uri: str, first_id: int, read_ids: int = READ_IDS) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Rows of a file's document table (``first`` counted from the first file) with their ids, some documents at a time."""
    reader = Reader(uri)
    at = 0
    while at < reader.n_docs:
        docs = reader.docs(at, 65_536)
        upto = int(np.searchsorted(docs["first"] + docs["n"], int(docs["first"][0]) + read_ids, side="right"))
        docs = docs[: max(1, upto)]
        start, n = int(docs["first"][0]), int(docs["n"].sum())
        ids = reader.ids(start, n)
        cuts = (docs["first"] - docs["first"][0]).astype(np.int64)
        out = docs.copy()
        out["first"] += np.uint64(first_id)
        yield out, [ids[a : a + k] for a, k in zip(cuts, docs["n"].astype(np.int64), strict=True)]
        at += len(docs)
    reader.close()


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """What the files hold: doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of the ids as 32-bit words)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for docs, ids in read_documents(uri, first):
                    known = docs["known"].astype(bool)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(docs["doc_id"].astype(np.int64), mask=~known),
                            pa.array(docs["first"].astype(np.int64)),
                            pa.array(docs["n"].astype(np.int64)),
                            pa.array(np.fromiter((zlib.crc32(x.tobytes()) for x in ids), dtype=np.int64, count=len(ids))),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    n = max(1, manifest.count())
    one_each = manifest.select("uri", "first_id").repartition(min(n, 4096))
    return one_each.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
