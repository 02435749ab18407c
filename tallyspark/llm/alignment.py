"""Tokens of two tokenizers over the same bytes, aligned with joins and windows.

``align`` is relational: tokens are posexploded, a windowed sum of their lengths gives where each ends, the tokens of both sides meet on key and end
(a full outer equi-join, written as grouping, since a side has an end once at most), an end of both is a cut, the running count of the cuts before a
token is its group, and the tokens of a key and group are linked, all of one side with all of the other. Nothing is compared but ends.

``align_documents`` aligns whole documents. Neither tokenizer joins characters across a blank between two printable characters (``SAFE``; a piece model with inner blanks
is told by its pieces, and texts then stay whole), so a document's tokens are those of its stretches between such blanks, one after the other, and each such blank is a
cut. Distinct stretches take the place of documents in ``align``: each is tokenized and aligned once in the whole corpus. Documents are
dealt into blocks of about ``BLOCK`` bytes of text by a hash of id and text. A block gets the aligned stretches that occur in it and puts its documents together:
once to count in how many documents each linked id pair stands, once, with these counts joined to the links, for the result.
No step holds more than a block, and what is shuffled for a stretch grows with the blocks that have it, not with its occurrences.

Null and empty texts have no tokens; nor has a text one of whose stretches does not come back byte for byte from both tokenizers. Equal rows (id and text) are
put together once and counted as often as they stand, so a row repeated without end is no large block; one id with two texts is two documents, and a null id is an id. A text of any
length is whole; one larger than a block is a block's only document. Ties for an A id's highest count all count as best. Extra columns are not carried. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fits_broadcast, release, scratch, small_batches, tidy
from .pieces import MARK, PieceModel

#: Bytes of text in a block, about.
BLOCK = 16 << 20
#: Bytes of text whose tokens are put together at a time.
SLICE = 2 << 20
#: So many id pairs (three numbers each) may be broadcast; more are joined.
PAIRS = 400_000
#: A blank between two of these belongs to the token after it, in both tokenizers.
SAFE = "[\\p{L}\\p{N}!-~]"
# Fixed value: the words of byte-level vocabularies.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
RESULT = "doc_id {}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


@contextmanager
def settings(spark: SparkSession, **wanted: str) -> Iterator[None]:
    """Session settings for the jobs inside."""
    names = {k: "spark.sql." + k.replace("_", ".") for k in wanted}
    before = {k: spark.conf.get(n) for k, n in names.items()}
    try:
        for k, v in wanted.items():
            spark.conf.set(names[k], v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(names[k], v)


def dropped(table: DataFrame) -> None:
    """Removes a table of ``written`` that nothing reads any more."""
    spark = table.sparkSession
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(table.path_)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder whose shuffles go when it is written, and whose joins by a key and more reuse what lies by that key: keys here are ids of short stretches, so none is hot."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with settings(spark, requireAllClusterKeysForCoPartition="false", classic_shuffleDependency_fileCleanup_enabled="true"):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.path_ = path
    return out


# Tokens


def _byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: itself if it is printable, else the next one from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in plain):
        out[chr(256 + n)] = b
    return out


class Tokenizers:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, a: str, b: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.first = Tokenizer.from_file(a)
        self.first.encode_special_tokens = True  # the strings of special tokens are plain text
        self.second = sentencepiece.SentencePieceProcessor(model_file=b)
        letters = _byte_letters()
        with open(a, encoding="utf-8") as f:
            special = {x["id"] for x in json.load(f)["added_tokens"]}
        vocab = {i: t.encode() if i in special else bytes(letters[c] for c in t) for t, i in self.first.get_vocab().items()}
        self.first_bytes = [vocab.get(i, b"") for i in range(max(vocab) + 1)]
        model = PieceModel.load(b)
        single = set(model.bytes.values())
        self.second_bytes = [x if i in single else x.decode().replace(MARK, " ").encode() for i, x in enumerate(model.raw)]
        self.width = len(self.second_bytes)
        self.apart = model.cut_marks
        self.ranked = self._ranked(a, special)
        self.tables = [(pa.array(x, pa.binary()), np.asarray([len(t) for t in x], dtype=np.int32)) for x in (self.first_bytes, self.second_bytes)]

    def _ranked(self, path: str, special: set[int]):
        """The same encoder in the library that is quicker on short texts, where the file's merges are in the order of ids and its words those of ``WORDS``; else None."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        vocab, words, model = found["model"]["vocab"], found["pre_tokenizer"] or {}, found["model"]
        merged = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
        plain = words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space") and not found["normalizer"] and not model.get("ignore_merges")
        if not plain or merged != sorted(merged) or -1 in merged:
            return None
        return tiktoken.Encoding("ranked", pat_str=WORDS, mergeable_ranks={x: i for i, x in enumerate(self.first_bytes) if x and i not in special}, special_tokens={})

    def first_ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of the first tokenizer."""
        if self.ranked is not None:
            return [self.ranked.encode_ordinary(x) for x in texts]
        return [e.ids for e in self.first.encode_batch(texts, add_special_tokens=False)]

    def encode(self, stretches: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """Whether both give the bytes of each stretch (with the blank before it) back, and for each tokenizer how many tokens each has, their ids and lengths."""
        spaced = [f" {x}" for x in stretches]
        found = [self.first_ids(spaced), self.second.encode(stretches, num_threads=1)]
        fine, out = np.ones(len(stretches), dtype=bool), []
        want = pa.array(spaced, pa.string()).cast(pa.binary())
        for ids, (raw, lengths) in zip(found, self.tables, strict=True):
            sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(sizes.sum()))
            each = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), raw.take(pa.array(flat)))
            fine &= pc.equal(pc.binary_join(each, b""), want).to_numpy(zero_copy_only=False)
            out.append((sizes, flat, lengths[flat]))
        return fine, out


@lru_cache(maxsize=2)
def load(a: str, b: str) -> Tokenizers:
    """Once per worker."""
    return Tokenizers(a, b)


# Alignment


def align(tokens: DataFrame, width: int, kind: str = "long") -> DataFrame:
    """``key, n_a, n_b, n_groups, n_links, groups, links`` for rows of ``key`` (unique), ``ids`` and ``lengths`` (arrays: of the tokens of A, then of B) and ``n_a``.

    ``groups`` is the text of all groups in order, ``links`` an array with ``a * width + b`` of type ``kind`` for every link. Keys without tokens have no row.
    """
    by_key = Window.partitionBy("key")
    each = tokens.repartition("key").select("key", "n_a", F.posexplode(F.arrays_zip("ids", "lengths")).alias("pos", "token"))
    each = each.select("key", "pos", (F.col("pos") >= F.col("n_a")).alias("other"), F.col("token.ids").alias("id"), F.col("token.lengths").alias("length"))
    ends = each.select("key", "other", "id", F.sum("length").over(Window.partitionBy("key", "other").orderBy("pos")).alias("end"))
    met = ends.groupBy("key", "end").agg(F.max(F.when(~F.col("other"), F.col("id"))).alias("a"), F.max(F.when(F.col("other"), F.col("id"))).alias("b"))
    before = F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).over(by_key.orderBy("end").rowsBetween(Window.unboundedPreceding, -1))
    ids = lambda x: F.filter(F.transform("tokens", lambda t: t[x]), lambda i: i.isNotNull())
    groups = met.select("key", "end", "a", "b", F.coalesce(before, F.lit(0)).alias("place")).groupBy("key", "place").agg(F.sort_array(F.collect_list(F.struct("end", "a", "b"))).alias("tokens"))
    groups = groups.select("key", "place", ids("a").alias("a"), ids("b").alias("b"))
    links = F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: (x.cast("long") * width + y).cast(kind))))
    groups = groups.select("key", "place", F.size("a").alias("n_a"), F.size("b").alias("n_b"), F.concat_ws("|", F.array_join("a", ","), F.array_join("b", ",")).alias("text"), links.alias("links"))
    parts = F.sort_array(F.collect_list(F.struct("place", "text", "links")))
    out = groups.groupBy("key").agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.count("*").alias("n_groups"), F.sum(F.col("n_a").cast("long") * F.col("n_b")).alias("n_links"), parts.alias("parts"))
    return out.select("key", "n_a", "n_b", "n_groups", "n_links", F.array_join(F.transform("parts", lambda x: x["text"]), ";").alias("groups"), F.flatten(F.transform("parts", lambda x: x["links"])).alias("links"))


# Documents


def _upto(sizes: pa.Array) -> np.ndarray:
    """Where parts of these sizes (null: 0) begin, and where the last one ends."""
    return np.concatenate([[0], np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False))]).astype(np.int64)


def _has(words: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(words, pattern).to_numpy(zero_copy_only=False).astype(bool)


def stretches_of(texts: pa.Array, apart: bool = True) -> tuple[pa.Array, np.ndarray]:
    """The stretches of texts (without the blank before each) one after the other, and where each text's begin; null texts have none."""
    if not apart:
        return texts.drop_null(), _upto(pc.is_valid(texts).cast(pa.int64()))
    lists = pc.split_pattern(texts, " ")
    words, at = lists.flatten(), _upto(pc.list_value_length(lists))
    named = words.dictionary_encode()
    plain = _has(named.dictionary, f"^{SAFE}((?s:.*){SAFE})?$")[named.indices.to_numpy()] if len(words) else np.zeros(0, dtype=bool)
    odd = _distinct(np.repeat(np.arange(len(texts)), np.diff(at))[~plain])
    if not len(odd):
        return words, at
    # Texts with blanks that belong to no word alone: words on both sides of such a blank are one stretch.
    parts, sizes, done = [], np.diff(at), 0
    for i in odd.tolist():
        own = words.slice(at[i], sizes[i])
        starts, ends = _has(own, f"^{SAFE}"), _has(own, f"{SAFE}$")
        cut = np.concatenate([[True], starts[1:] & ends[:-1]])
        plain_words = own.to_pylist()
        edges = [*np.flatnonzero(cut).tolist(), len(plain_words)]
        parts += [words.slice(done, at[i] - done), pa.array([" ".join(plain_words[x:y]) for x, y in zip(edges, edges[1:], strict=False)], pa.string())]
        sizes[i], done = len(edges) - 1, at[i + 1]
    return pa.concat_arrays([*parts, words.slice(done)]), np.concatenate([[0], np.cumsum(sizes)])


def _slices(docs: pa.Table, apart: bool) -> Iterator[tuple[pa.Table, pa.Array, np.ndarray]]:
    """Documents of about ``SLICE`` bytes, their stretches one after the other, and where each document's begin and end."""
    docs = docs.combine_chunks()
    size = _upto(pc.binary_length(docs.column("text")))[1:]
    edges = [0, *(np.flatnonzero(np.diff(size // SLICE)) + 1).tolist(), docs.num_rows] if docs.num_rows else []
    for a, b in zip(edges, edges[1:], strict=False):
        own = docs.slice(a, b - a)
        yield own, *stretches_of(own.column("text").combine_chunks(), apart)


def _held(known: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A column of arrays as one array, and where each row's part begins; the last begins where all end."""
    column = known.column(name).combine_chunks() if known.num_rows else pa.array([], pa.list_(pa.int64()))
    return column.flatten().to_numpy(), _upto(pc.list_value_length(column))


def _known(known: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """The stretches of a block, and whether each came back whole."""
    column = known.column("stretch").combine_chunks() if known.num_rows else pa.array([], pa.string())
    return column, known.column("fine").to_numpy().astype(bool)


def _gathered(values: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of ``values`` that rows ``at`` have, one after the other, and how long each is."""
    sizes = ends[at + 1] - ends[at]
    start = np.repeat(ends[at] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) if len(at) else np.zeros(0, dtype=np.int64)
    return values[np.arange(len(start)) + start], sizes


def _distinct(x: np.ndarray) -> np.ndarray:
    """Each number once, in order; numpy's own ``unique`` puts millions of them into a table, which takes far longer than sorting."""
    x = np.sort(x)
    return x[np.concatenate([np.ones(min(1, len(x)), dtype=bool), x[1:] != x[:-1]])]


def pair_counts_of(docs: pa.Table, known: pa.Table, apart: bool = True) -> pa.Table:
    """In how many documents of a block each id pair is linked."""
    stretches, fine = _known(known)
    links, ends = _held(known, "links")
    names, place = np.unique(links, return_inverse=True)
    place = place.astype(np.int32)
    total = np.zeros(len(names), dtype=np.int64)
    for own, flat, at in _slices(docs, apart):
        which = pc.index_in(flat, value_set=stretches).to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(own.num_rows), np.diff(at))
        bad = np.zeros(own.num_rows, dtype=bool)
        bad[doc[~fine[which]]] = True
        use = _distinct(doc[~bad[doc]] * len(stretches) + which[~bad[doc]])  # each stretch of a document once
        doc, which = use // max(1, len(stretches)), use % max(1, len(stretches))
        pairs, sizes = _gathered(place, ends, which)
        small = np.int32 if own.num_rows * max(1, len(names)) < 1 << 31 else np.int64
        both = _distinct(np.repeat((doc * max(1, len(names))).astype(small), sizes) + pairs).astype(np.int64)
        weights = own.column("n").to_numpy()[both // max(1, len(names))]
        total += np.bincount(both % max(1, len(names)), weights=weights, minlength=len(names)).astype(np.int64)[: len(names)]
    release()  # workers live on through stages that need memory elsewhere
    return pa.table({"pair": pa.array(names.astype(np.int64)), "n": pa.array(total)})


def digests_of(docs: pa.Table, known: pa.Table, apart: bool = True) -> pa.Table:
    """The result for the documents of a block."""
    known = known.combine_chunks()
    stretches, written_, texts = (known.column(x).combine_chunks() if known.num_rows else pa.array([], pa.string()) for x in ("stretch", "numbers", "groups"))
    fine = pc.is_valid(written_).to_numpy(zero_copy_only=False)
    each = pc.split_pattern(pc.fill_null(written_, " ".join("0" * len(NUMBERS))), " ").flatten().cast(pa.int64()).to_numpy().reshape(-1, len(NUMBERS))
    sums = {x: each[:, i] for i, x in enumerate(NUMBERS)}
    out: dict[str, list] = {x: [] for x in ("doc_id", *NUMBERS, "groups_sha256", "n")}
    for own, flat, at in _slices(docs, apart):
        which = pc.index_in(flat, value_set=stretches).to_numpy().astype(np.int64)
        size = np.diff(at)
        doc = np.repeat(np.arange(own.num_rows), size)
        bad = size == 0
        bad[doc[~fine[which]]] = True
        for x in NUMBERS:
            upto = np.concatenate([[0], np.cumsum(sums[x][which])])
            out[x].append(np.where(bad, 0, upto[at[1:]] - upto[at[:-1]]))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), texts.take(pa.array(which))), ";").cast(pa.binary())
        out["groups_sha256"] += ["" if b else hashlib.sha256(memoryview(x.as_buffer())).hexdigest() for b, x in zip(bad, joined, strict=True)]
        out["doc_id"].append(own.column("doc_id").combine_chunks())
        out["n"].append(own.column("n").to_numpy())
    flat = {x: pa.array(np.concatenate(out[x]) if out[x] else np.zeros(0, dtype=np.int64), pa.int64()) for x in (*NUMBERS, "n")}
    release()
    ids = pa.chunked_array(out["doc_id"], docs.schema.field("doc_id").type)
    return pa.table({"doc_id": ids, **{x: flat[x] for x in NUMBERS}, "groups_sha256": pa.array(out["groups_sha256"], pa.string()), "n": flat["n"]})


def dealt_documents(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``block, doc_id, text, n``: a row for each id and text, with how many rows have them; empty texts are null."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.nullif(F.col(text), F.lit("")).alias("text"))
    same = F.xxhash64("text")
    facts = written(rows.groupBy("doc_id", same.alias("h")).agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")), "rows")
    blocks = max(1, -(-(facts.agg(F.sum("bytes")).first()[0] or 0) // BLOCK))
    rows = rows.withColumn("n", F.lit(1).cast("long"))
    more = facts.where("n > 1").select(F.col("doc_id").alias("d2"), "h")
    if not more.isEmpty():
        known = F.broadcast(more) if fits_broadcast(more) else more
        once = rows.join(known, F.col("doc_id").eqNullSafe(F.col("d2")) & (same == F.col("h")), "left")
        repeated = once.where("h is not null").groupBy("doc_id", "text").agg(F.count("*").alias("n"))
        rows = once.where("h is null").select("doc_id", "text", "n").unionByName(repeated)
    return rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"), "doc_id", "text", "n")


def aligned_stretches(dealt: DataFrame, a: str, b: str) -> DataFrame:
    """``key, stretch, blocks, fine, n_a, n_b, n_groups, n_links, groups, links`` of every distinct stretch, written once."""
    small_batches(dealt.sparkSession, 8192)
    tokenizers = load(a, b)
    apart, width = tokenizers.apart, tokenizers.width
    kind = "int" if len(tokenizers.first_bytes) * width < 1 << 31 else "long"

    def distinct(block: pa.Table) -> pa.Table:
        found = pc.unique(pa.chunked_array([pc.unique(flat) for _, flat, _ in _slices(block, apart)], pa.string()))
        return pa.table({"block": pa.array(np.full(len(found), block.column("block")[0].as_py()), pa.int64()), "stretch": found})

    found = dealt.where("text is not null").select("block", "text").groupBy("block").applyInArrow(distinct, "block long, stretch string")
    each = found.groupBy("stretch").agg(F.collect_list("block").alias("blocks"))

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = load(a, b)
        for x in batches:
            fine, (first, second) = both.encode(x.column(0).to_pylist())
            # The tokens of A, then of B, of each stretch that both give back.
            sizes = np.stack([first[0] * fine, second[0] * fine], axis=1)
            ids, lengths = (np.zeros(int(sizes.sum()), dtype=np.int32) for _ in range(2))
            begin = np.concatenate([[0], np.cumsum(sizes)])[:-1].reshape(sizes.shape) if len(sizes) else sizes
            for side, (own, i, n) in enumerate((first, second)):
                use = np.repeat(fine, own)
                at = np.repeat(begin[:, side], sizes[:, side]) + np.arange(int(sizes[:, side].sum())) - np.repeat(np.cumsum(sizes[:, side]) - sizes[:, side], sizes[:, side])
                ids[at], lengths[at] = i[use], n[use]
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes.sum(axis=1))]), pa.int32())
            arrays = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (ids, lengths)]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(fine), pa.array(sizes[:, 0].astype(np.int32)), *arrays], names=["stretch", "blocks", "fine", "n_a", "ids", "lengths"])

    tokens = each.mapInArrow(tidy(tokenize), "stretch string, blocks array<long>, fine boolean, n_a int, ids array<int>, lengths array<int>")
    tokens = written(tokens.withColumn("key", F.monotonically_increasing_id()), "tokens")
    lined = align(tokens.where("fine").select("key", "n_a", "ids", "lengths"), width, kind)
    each = written(tokens.select("key", "stretch", "blocks", "fine").join(lined, "key", "left"), "aligned")
    dropped(tokens)
    return each


def align_documents(docs: DataFrame, a: str, b: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """For each row: tokens by both, groups, links, those that are an A id's most frequent, the sum of their counts, and the hash of the groups."""
    spark = docs.sparkSession
    small_batches(spark)
    dealt = dealt_documents(docs, text, doc_id)
    each = aligned_stretches(dealt, a, b)
    tokenizers = load(a, b)
    apart, width = tokenizers.apart, tokenizers.width
    by_block = each.select(F.explode("blocks").alias("block"), "stretch", "fine", "links")
    in_block = dealt.where("text is not null").select("block", "text", "n").groupBy("block")
    counted = in_block.cogroup(by_block.groupBy("block")).applyInArrow(lambda x, y: pair_counts_of(x, y, apart), "pair long, n long")
    counts = written(counted.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("a", F.expr(f"pair div {width}")), "pairs")
    most = counts.groupBy(F.col("a").alias("a2")).agg(F.max("count").alias("most"))
    judged = counts.join(most, F.col("a") == F.col("a2")).select(F.col("pair").alias("p2"), "count", (F.col("count") == F.col("most")).cast("int").alias("best"))
    judged = written(judged, "judged")
    linked = each.select("key", F.explode("links").alias("pair")).join(F.broadcast(judged) if fits_broadcast(judged, PAIRS) else judged, F.col("pair") == F.col("p2"))
    told = linked.groupBy("key").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
    # What a document adds up, as one short text; null where the stretch did not come back.
    numbers = F.when(F.col("fine"), F.concat_ws(" ", *[F.coalesce(F.col(x), F.lit(0)).cast("string") for x in NUMBERS]))
    whole = written(each.drop("links").join(told, "key", "left").select("stretch", "blocks", numbers.alias("numbers"), F.coalesce("groups", F.lit("")).alias("groups")), "told")
    dropped(each)
    by_block = whole.select(F.explode("blocks").alias("block"), "stretch", "numbers", "groups")
    kind = docs.schema[doc_id].dataType.simpleString()
    out = dealt.groupBy("block").cogroup(by_block.groupBy("block")).applyInArrow(lambda x, y: digests_of(x, y, apart), f"{RESULT.format(kind)}, n long")
    return out.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n", "col")
