from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute
from tidemark.llm import alignment, queries
from tidemark.llm.alignment import SPAN, align, digits, held_bytes, held_of, labels

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")
FILES = (*map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def plain():
    """The two tokenizers and their entries as bytes, without the operator's code."""
    a = tokenizers.Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=FILES[2])
    # The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on.
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in own} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in own)}
    entries_a = [bytes(letters[c] for c in a.id_to_token(i)) if i != 50256 else b"" for i in range(a.get_vocab_size())]
    named = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    entries_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(named)]
    return lambda t: a.encode(t, add_special_tokens=False).ids, lambda t: b.encode(t), entries_a, entries_b


def rows_of(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in df.select(names).collect()), key=str)


ODD = [
    (100, None), (101, ""), (102, " "), (103, "  two   spaces \n\n\tand ends  "), (104, "a ▁ b"), (105, "<|endoftext|> <s> </s> <unk> <0x41>"), (106, "日本語 ﬁ é é 😀"),
    (107, "nul \x00 and \x1c ​"), (None, "no id"), (108, "same row"), (108, "same row"), (109, "x" * 5000), (110, "﻿ "),
]


def test_rows_equal_a_token_by_token_walk(spark, plain, monkeypatch):
    rng = random.Random(2)
    words = ["the", "Wörter", "tokenizer", "Straße", "123456", "naïve", "e.g.", "它们", "don't", "\n", "  ", "éàü", "x=y;", "🙂🙂"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(90)] + ODD
    schema = "doc_id long, text string"
    df = spark.createDataFrame([(*d, 1, "p", 2) for d in docs], schema + ", unit int, pairs string, n_a int").repartition(3)
    want = sorted(brute.alignment(docs, *plain), key=str)
    assert rows_of(align(df, *FILES)) == want
    assert sum(r[1] == 0 for r in want) == 3
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert rows_of(align(df, *FILES)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_units_and_slices_do_not_matter(plain):
    """Small units with lists of several rows give the same as one unit."""
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "Gamma-ray", "δ", "9.81"]) for _ in range(rng.randint(0, 30)))) for i in range(40)]
    pair = alignment.Pair(*FILES[:3], FILES[3])
    want = brute.alignment(docs, *plain)
    for size in (1, 11, 40):
        got, total = [], {}
        units = []
        for low in range(0, 40, size):
            unit = alignment.Unit(pair, low)
            for k in range(low, min(low + size, 40), 4):
                part = docs[k : min(k + 4, low + size, 40)]
                unit.add(pa.array([i for i, _ in part]), pa.array([t for _, t in part]))
            table = pa.Table.from_batches(list(unit.batches()))
            lists = [r for r in table.to_pylist() if r["first"] is not None]
            pairs = [p for r in lists for p in r["pairs"]]
            for p, n in zip(pairs, (n for r in lists for n in r["counts"]), strict=True):
                total[p] = total.get(p, 0) + n
            units.append((table, pairs))
        best: dict = {}
        for p, n in total.items():
            best[p & 0xFFFFFFFF] = max(n, best.get(p & 0xFFFFFFFF, 0))
        for table, pairs in units:
            answers = pa.table({"place": np.arange(len(pairs)), "total": [total[p] for p in pairs], "best": [int(total[p] == best[p & 0xFFFFFFFF]) for p in pairs]})
            answers = answers.take(pa.array(np.random.default_rng(1).permutation(len(pairs)))).cast(pa.schema([(c, pa.int64()) for c in ("place", "total", "best")]))
            got += [tuple(r.values()) for r in alignment._finish(table.filter(pa.compute.is_null(table["first"])), answers).to_pylist()]
        assert got == want


def test_the_query_on_the_given_table(spark, sf_dir, plain):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert rows_of(queries.op11_alignment(spark, sf_dir)) == sorted(brute.alignment(docs, *plain), key=str)


def test_a_very_long_text(spark, plain):
    docs = [(1, "long word salad, über alles " * 60_000), (2, "long word")]
    assert rows_of(align(spark.createDataFrame(docs, "doc_id long, text string"), *FILES)) == sorted(brute.alignment(docs, *plain), key=str)


def test_an_empty_table(spark):
    assert align(spark.createDataFrame([], "doc_id long, text string"), *FILES).count() == 0
    assert rows_of(align(spark.createDataFrame([(1, None)], "doc_id long, text string"), *FILES)) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_label_string_and_spans():
    text = labels(np.array([2, 3, 6]), np.array([3, 5, 6]), 6)
    assert text == b".ax.bx" and [m.span() for m in SPAN.finditer(text)] == [(0, 3), (3, 6)]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 70_000), min_size=1, max_size=30))
def test_digits(ids):
    text, ends = digits(np.array(ids), np.full(len(ids), 44, np.uint8))
    assert text.tobytes().decode() == "".join(f"{i}," for i in ids) and ends[-1] == len(text)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 1 << 22), st.integers(1, 1 << 20), max_size=8), min_size=1, max_size=6))
def test_held_pairs_come_back(rows):
    flat = [(k, p, n) for k, row in enumerate(rows) for p, n in sorted(row.items())]
    owner, place, times = (np.array([f[i] for f in flat], np.int64) for i in range(3))
    for row, packed in zip(rows, held_bytes(place, times, owner, len(rows)), strict=True):
        at, n = held_of(packed)
        assert dict(zip(at.tolist(), n.tolist(), strict=True)) == row
