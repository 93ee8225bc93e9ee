"""Packing, separator scan and token files against the tokenizers library itself."""

from __future__ import annotations

import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roundhouse.llm import packing, separators, token_files_zstd
from roundhouse.llm.shared import Scratch
from roundhouse.llm.tokenfiles import create
from roundhouse.llm.tokens import BYTE_BPE, WORD_BPE, Encoder, encoder, public_path

from llm_edges import edge_texts


def plain_ids(texts, name, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_path(name))
    t.encode_special_tokens = True
    return [t.encode(x or "", add_special_tokens=False).ids + [end] for x in texts]


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_encoder_is_the_tokenizer(docs, name):
    texts = edge_texts() + [r.text for r in docs.select("text").collect()]
    odd = ["a \nb", "a\n b", "a  b", "a   b", "a \n", "a\n ", " a", "é́ x", "don't 'tis we'RE", "a.'s b", "x' s", "…— “q”", "ß ẞ İ", "\x1ca b", "a1b2 3c", "1\xb2", "a\x85 b"]
    texts += odd + [f"{a}{b}{c}" for a in ("", "x", "x.", "1", "\n") for b in (" ", "  ", "\n", " \n", "\n ", "\t") for c in ("", "y", "'s", "!", "é")]
    small = Encoder(name)
    got = [np.frombuffer(b, "<u4").tolist() + [7] for b in small.encode(texts)]
    assert got == plain_ids(texts, name, 7)


def test_memory_of_many_words():
    """A worker that has met 800,000 words holds them in some tens of MB."""
    import subprocess
    import sys

    made = """
import resource
from roundhouse.llm.tokens import BYTE_BPE, Encoder
e = Encoder(BYTE_BPE)
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
name = lambda k: "".join(chr(97 + k // 26**j % 26) for j in range(5))
sum(map(len, e.encode(" ".join(map(name, range(s, s + 100))) for s in range(0, 40_000, 100))))
before = peak()
for start in range(40_000, 840_000, 40_000):
    sum(map(len, e.encode(" ".join(map(name, range(s, s + 100))) for s in range(start, start + 40_000, 100))))
print(peak() - before)
"""
    done = subprocess.run([sys.executable, "-c", made], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    assert float(done.stdout) < 90


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_full_memory_goes_on(monkeypatch, name):
    from roundhouse.llm import tokens

    monkeypatch.setattr(tokens, "KEPT", 20)
    monkeypatch.setattr(tokens, "LONGEST", 6)
    monkeypatch.setattr(tokens, "TOGETHER", 40)
    texts = ["one two, three. two", None, "", "two, (three) four five six-seven", "É été, étés; don't x2, ...", "abcdefgh abcdefgh, one"] * 3
    small = Encoder(name)
    assert [np.frombuffer(b, "<u4").tolist() + [7] for b in small.encode(texts)] == plain_ids(texts, name, 7)
    assert len(small.words) == len(small.ids) <= 20
    assert max(map(len, small.words.to_pylist())) <= 6


def test_long_text_in_steps(monkeypatch):
    from roundhouse.llm import tokens

    text = edge_texts()[18]
    whole = encoder(BYTE_BPE).whole(text)
    monkeypatch.setattr(tokens, "STEP", 1000)
    monkeypatch.setattr(tokens, "KEPT", 50)
    assert next(Encoder(BYTE_BPE).encode([text])) == whole


def check_pieces(rows, window, expected):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    stream = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    at = 0
    for r in stream:  # no gap and no overlap
        assert (r.sequence_id, r.offset) == divmod(at, window)
        at += r.length
        assert r.offset + r.length <= window and r.length > 0
    assert sorted(by_doc) == sorted(expected)
    for key, wanted in expected.items():
        parts = sorted(by_doc[key], key=lambda r: r.start)
        assert [p.start for p in parts] == list(np.cumsum([0] + [p.length for p in parts])[:-1])
        assert b"".join(bytes(p.ids) for p in parts) == np.asarray(wanted, "<u4").tobytes()
        assert {p.doc_tokens for p in parts} == {len(wanted)}


@pytest.mark.parametrize("window", [7, 2048])
def test_packing(docs, window):
    some = docs.select("doc_id", "text").unionAll(docs.sparkSession.createDataFrame([(10_000 + i, t) for i, t in enumerate(edge_texts()[:12])], "doc_id bigint, text string")).repartition(5)
    local = some.toPandas()
    if window == 7:
        local = local[local.doc_id % 9 == 1]
        some = some.where("doc_id % 9 = 1")
    rows = packing.pack(some, BYTE_BPE, 1, window).collect()
    check_pieces(rows, window, dict(zip(local.doc_id, plain_ids([None if pd.isna(t) else t for t in local.text], BYTE_BPE, 1))))
    seqs = packing.sequences(packing.pack(some, BYTE_BPE, 1, window), window).orderBy("sequence_id").collect()
    assert all(s.n_tokens == window for s in seqs[:-1]) and all(len(s.ids) == 4 * s.n_tokens for s in seqs)


def test_packing_edges(edge_docs, no_docs):
    rows = packing.pack(edge_docs, BYTE_BPE, 1, 64).collect()
    assert sum(r.length for r in rows) == sum(len(x) for x in plain_ids([r.text for r in edge_docs.collect()], BYTE_BPE, 1))
    assert packing.pack(no_docs, BYTE_BPE, 1).collect() == []
    assert packing.sequences(packing.pack(no_docs, BYTE_BPE, 1)).collect() == []


def test_token_files(spark, edge_docs, no_docs):
    folder = Scratch(spark, "t").folder
    manifest = token_files_zstd.write(edge_docs, folder, WORD_BPE, 2)
    rows = sorted(token_files_zstd.read(spark, manifest).collect(), key=lambda r: r.start)
    local = sorted(((r.doc_id, r.text) for r in edge_docs.collect()), key=lambda r: (r[0], r[1] or ""))
    wanted = plain_ids([t for _, t in local], WORD_BPE, 2)
    assert [r.doc_id for r in rows] == [i for i, _ in local]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in rows] == wanted
    assert [r.start for r in rows] == list(np.cumsum([0] + [len(w) for w in wanted])[:-1])
    path = manifest.where("n_docs > 2").first().path
    shard = token_files_zstd.Shard(path)
    assert shard.document(1) == b"".join(ids for _, part in shard.batches(1) for ids in part[:1])[len(shard.document(0)) :][: len(shard.document(1))]
    empty = token_files_zstd.write(no_docs, Scratch(spark, "t").folder, WORD_BPE, 2)
    assert empty.count() == 0 and token_files_zstd.read(spark, empty).count() == 0


def library_ids(texts, name, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_path(name))
    return [t.encode(x or "", add_special_tokens=False).ids + [end] for x in texts]


SPECIAL = ["a <|endoftext|> is text", "<|endoftext|>", "x<|startoftext|>y <|endoftext|><|endoftext|>", "<|EndOfText|> <|endoftext", "plain words", None]


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_added_tokens_have_their_ids(name):
    texts = edge_texts() + SPECIAL
    assert [np.frombuffer(b, "<u4").tolist() + [7] for b in Encoder(name, plain=False).encode(texts)] == library_ids(texts, name, 7)
    assert [np.frombuffer(b, "<u4").tolist() + [7] for b in Encoder(name).encode(texts)] == plain_ids(texts, name, 7)


def test_registered_queries_take_added_tokens(spark, tmp_path):
    from roundhouse.llm import queries

    spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for run, name, end in ((queries.op1_packing, BYTE_BPE, 1), (queries.op9_token_files, WORD_BPE, 2)):
        wanted = {k: zlib.crc32(np.asarray(ids, "<u4").tobytes()) for k, ids in enumerate(library_ids(SPECIAL, name, end))}
        assert {r.doc_id: r.ids_crc32 for r in run(spark, str(tmp_path)).collect()} == wanted


def test_token_file_checks_its_dictionary(spark, docs):
    folder = Scratch(spark, "t").folder
    row = token_files_zstd.write(docs, folder, WORD_BPE, 2).first()
    with create(f"{folder}/{row.dictionary}.dictionary") as out:
        out.write(b"something else")
    with pytest.raises(ValueError):
        token_files_zstd.Shard(row.path)


def test_separator_scan_over_blocks_and_files(spark):
    rng = np.random.default_rng(3)
    folder, files, stream = Scratch(spark, "t").folder, [], []
    for k, n in enumerate([0, 1, 50, 7, 0, 333, 64, 5]):
        ids = rng.choice([9, 1, 2, 3, 4, 5, 6], n).astype("<u2")
        if k == 5:
            ids[20:250] = 1  # one document over many blocks
        if k == 7:
            ids[:] = 4  # no separator at the end
        with create(f"{folder}/{k}.ids") as out:
            out.write(ids.tobytes())
        files.append((f"{folder}/{k}.ids", n))
        stream += ids.tolist()
    got = separators.scan(spark, pd.DataFrame(files, columns=["path", "n_ids"]), 9, block_ids=16).orderBy("doc_no").collect()
    wanted, start = [], 0
    for i, x in enumerate(stream):
        if x == 9:
            wanted.append((len(wanted), start, i + 1 - start, True))
            start = i + 1
    if start < len(stream):
        wanted.append((len(wanted), start, len(stream) - start, False))
    assert [tuple(r) for r in got] == wanted


def test_token_counts(spark, edge_docs, no_docs):
    rows = separators.count_documents(edge_docs, Scratch(spark, "t").folder, BYTE_BPE, 50256, block_ids=1000).collect()
    wanted = sorted((r.doc_id, len(plain_ids([r.text], BYTE_BPE, 0)[0])) for r in edge_docs.collect())
    assert sorted((r.doc_id, r.n_tokens) for r in rows) == wanted
    assert sorted(r.start for r in rows)[-1] < sum(n for _, n in wanted)
    assert separators.count_documents(no_docs, Scratch(spark, "t").folder, BYTE_BPE, 50256).collect() == []


def test_crc_of_ids(spark):
    ids = np.arange(5, dtype="<u4").tobytes()
    assert spark.createDataFrame([(bytearray(ids),)], "ids binary").select(F.crc32("ids")).first()[0] == zlib.crc32(ids)
    assert pa.array([ids]).type == pa.binary()
