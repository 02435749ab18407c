"""Alignment of two tokenizers against whole texts run through both libraries."""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyspark.llm import alignment, queries
from tallyspark.llm.common import table

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


class Whole:
    """Both libraries over whole texts; bytes of tokens read from the vocabulary files."""

    def __init__(self):
        self.a = Tokenizer.from_file(queries.byte_bpe())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=queries.piece_bpe())
        with open(queries.byte_bpe(), encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = [b for b in range(256) if b not in shown]
        of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
        self.a_bytes = {i: bytes(of[c] for c in t) for t, i in vocab.items()}

    def b_bytes(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def groups(self, text):
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        x, y = [self.a_bytes[i] for i in a], [self.b_bytes(i) for i in b]
        if not b"".join(x) == b"".join(y) == (" " + text).encode():
            return []
        ends = list(accumulate(map(len, x))), list(accumulate(map(len, y)))
        cuts = sorted(set(ends[0]) & set(ends[1]))
        inside = lambda ids, e, low, high: [i for i, at in zip(ids, e, strict=True) if low < at <= high]
        return [(inside(a, ends[0], low, high), inside(b, ends[1], low, high)) for low, high in zip([0, *cuts], cuts, strict=False)]


def brute(rows):
    whole = Whole()
    groups = [whole.groups(t) if t else [] for _, t in rows]
    count = Counter(p for g in groups for p in {(x, y) for a, b in g for x in a for y in b})
    most = Counter()
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for (i, _), g in zip(rows, groups, strict=True):
        links = [(x, y) for a, b in g for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=repr)


def got(docs):
    found = alignment.align_documents(docs, queries.byte_bpe(), queries.piece_bpe())
    assert found.columns == COLUMNS
    return sorted((tuple(r) for r in found.collect()), key=repr)


ODD = ["", None, " ", "  ", "a", " a", "a ", "a  b", "a\nb\n\n c \n", "\tx\ty  \n  z", "it's we'll DON'T 'S", "<|endoftext|> <s></s> <0x41> <unk> x", "x▁y z", "▁", "naïve café ÀÉ ß ﬁ ½ ①", "日本語のテキスト と 中文", "🙂 🙂🙂 a🙂b", "a b 　c d e\u0085f", "é x́", "\x00 a\x00b", "12345 67,890.12 $%^ &*()", "left \x01 right side", "word " * 3000, "q" * 3000, "a" + " " * 50 + "b", "​ x‍ y", "A B C", "A B C"]


@pytest.mark.parametrize("block", [1 << 24, 300])
def test_odd_texts(spark, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK", block)
    monkeypatch.setattr(alignment, "SLICE", 500)
    monkeypatch.setattr(alignment, "PAIRS", block)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "A B C"), (None, "A b"), (None, None), (50, "same row"), (50, "same row"), (50, "same row"), (51, "same row")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("block", "n", "key", "d2", "h", "stretch")})
    assert got(docs) == brute(rows)


def test_tables(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    assert got(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_no_documents(spark):
    assert got(spark.createDataFrame([], "doc_id long, text string")) == []
    assert got(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]


def test_align_by_ends(spark):
    """Tokens of one key: cuts, groups and links by hand."""
    rows = [(7, [1, 2, 3, 10, 11, 12, 13], [2, 2, 3, 1, 3, 1, 2], 3), (8, [5, 6], [4, 4], 1), (9, [], [], 0)]
    tokens = spark.createDataFrame(rows, "key long, ids array<int>, lengths array<int>, n_a int")
    found = {r["key"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups"], [divmod(x, 100) for x in r["links"]]) for r in alignment.align(tokens, 100).collect()}
    assert found == {7: (3, 4, 2, 6, "1,2|10,11;3|12,13", [(1, 10), (1, 11), (2, 10), (2, 11), (3, 12), (3, 13)]), 8: (1, 1, 1, 1, "5|6", [(5, 6)])}


def test_stretches_join_again():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("ab  \n\té,1▁"), 30)) or "a" for _ in range(200)] + [None, "a", " ", "a b"]
    flat, at = alignment.stretches_of(pa.array(texts))
    found = flat.to_pylist()
    assert [" ".join(found[x:y]) if y > x else None for x, y in zip(at, at[1:], strict=False)] == texts
    assert alignment.stretches_of(pa.array(["a b", "a  b", "a\n b c"]))[0].to_pylist() == ["a", "b", "a  b", "a\n b", "c"]
    assert alignment.stretches_of(pa.array(["a b", None]), apart=False)[0].to_pylist() == ["a b"]


def test_both_encoders_of_the_first_tokenizer():
    both = alignment.load(queries.byte_bpe(), queries.piece_bpe())
    rng = np.random.default_rng(1)
    texts = [f" {t}" for t in ODD if t] + ["".join(map(chr, rng.choice([*range(1, 128), 0xA0, 0xE9, 0x301, 0x2003, 0x3042, 0x1F642], 40))) for _ in range(2000)]
    assert both.ranked is not None
    assert both.first_ids(texts) == [e.ids for e in both.first.encode_batch(texts, add_special_tokens=False)]
