"""Chat formatting, spelling variants and importance resampling against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from llm_edges import SCHEMA
from pyspark.sql import functions as F

from roundhouse.llm import chat, importance, spellings

TURNS = "conv_id bigint, turn bigint, role string, text string, example string"
BITS = ["<|im_start|>", "<|im_sep|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<", "[", "\\", "s>", "/s>", "|im_end|>", "INST]", "$1", "a", " ", "\n", "é", "😀"]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_chat(rows):
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        talks[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in talks.items():
        turns.sort()
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        out[conv] = (len(turns), digest("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), len(loss), digest(loss))
    return out


@pytest.fixture(scope="module")
def talks(spark):
    draw = random.Random(11)
    rows = []
    for conv in range(40):
        for turn in range(draw.randint(1, 9)):
            rows.append((conv, turn, draw.choice(["user", "assistant", "assistant", "system", "tool", "<|im_sep|>", None]), "".join(draw.choices(BITS, k=draw.randint(0, 12))), "x"))
    rows += [(50, k, "assistant" if k % 2 else "user", f"turn {k} </s>", None) for k in range(300)]  # more replies than a block
    rows += [(51, None, "user", None, None), (51, None, "assistant", "late", None), (51, 0, "assistant", "same", None), (51, 0, "assistant", "same", None)]
    rows += [(None, 1, "user", "no id", None), (None, 2, "assistant", "none", None), (52, 0, "assistant", "long " * 40_000, None)]
    return spark.createDataFrame(rows, TURNS).repartition(5)


def test_chat_gives_turns_and_replies_back(talks):
    found = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(chat.examples(talks)).collect()}
    assert found == plain_chat([tuple(r)[:4] for r in talks.collect()])


def test_chat_examples(talks):
    template = chat.Template()
    marks = (template.begin, template.middle, template.end)
    pattern = "|".join(map(re.escape, (*marks, *template.controls)))
    rows = talks.collect()
    by = defaultdict(list)
    for r in chat.examples(talks).collect():
        by[r.conv_id].append(r)
    for conv, own in by.items():
        own.sort(key=lambda r: r.example)
        turns = sorted((r for r in rows if r.conv_id == conv), key=lambda r: (r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
        replies = [i for i, r in enumerate(turns) if r.role == "assistant"]
        ends = replies if replies and replies[-1] == len(turns) - 1 else [*replies, len(turns) - 1]
        assert [r.example for r in own] == list(range(len(ends))) and [r.last for r in own] == [False] * (len(ends) - 1) + [True]
        for r, end in zip(own, ends):
            found = re.findall(pattern, r.text)
            assert found == list(marks) * (end + 1)  # no text shows a control string
            assert own[-1].text.startswith(r.text)
            assert r.loss_length == 0 if end not in replies else r.text[r.loss_start + r.loss_length :] == template.end


def test_chat_template_and_empty_table(spark):
    with pytest.raises(ValueError):
        chat.Template(controls=("<a", "x<"))
    assert chat.read_back(chat.examples(spark.createDataFrame([], TURNS))).collect() == []


def plain_variants(rows, damage):
    counts = Counter()
    for key, text in rows:
        plain = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for word in re.findall("[a-zÀ-ÿ]+", plain):
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if damage and h % damage == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    by_length = defaultdict(list)
    for w in counts:
        by_length[len(w)].append(w)
    out, form = {}, {}
    for w, n in counts.items():
        close = [v for k in (-1, 0, 1) for v in by_length[len(w) + k] if near(w, v)]
        best = min(close, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
        out[w] = (n, len(close))
    rows = []
    for w, (n, close) in out.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n, close, counts[form[w]] if form[w] is not None else None))
    return sorted(rows)


def variant_rows(frame, **options):
    return sorted(tuple(r) for r in spellings.variants(frame, **options).select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("range_words", [20_000, 7])
def test_variants(spark, edge_docs, monkeypatch, range_words):
    monkeypatch.setattr(spellings, "RANGE_WORDS", range_words)
    draw = random.Random(12)
    base = ["".join(draw.choices("abÀé", k=draw.randint(4, 9))) for _ in range(150)] + ["aaaaa", "aaaaaa", "aaaaaaa", "baaaaa", "z" * 3000, "z" * 3001, "y" + "z" * 2999]
    texts = [" ".join(draw.choices(base, weights=[1 / (k + 1) for k in range(len(base))], k=300)) + draw.choice([" A×B÷ccccc", "-ŒUVRE œuvre 日本", ""]) for _ in range(30)]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(None, texts[0].upper(), None, None, None)] + [(900, " ".join(["z" * 3000, "z" * 3001, "y" + "z" * 2999] * 4), None, None, None)] * 2
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for docs in (frame, edge_docs):
        for damage in (None, 7):
            assert variant_rows(docs, damage=damage) == plain_variants([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], damage)


def test_variants_of_the_given_documents(spark, docs, no_docs):
    found = variant_rows(docs, damage=97)
    assert found == plain_variants([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 97)
    assert any(r[1] for r in found)
    assert variant_rows(no_docs) == []


def plain_draw(rows, target, percent=25, least=20, buckets=10_000, seed=7):
    def features(text):
        plain = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", plain)
        return len(words), [zlib.crc32(f.encode()) % buckets for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]

    told = [(key, *features(text)) for key, text in rows]
    s, t = Counter(), Counter()
    for _, _, found in told:
        s.update(found)
    for text in target:
        t.update(features(text)[1])
    total_s, total_t = float(sum(s.values())), float(sum(t.values()))
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (total_s + buckets) / ((s[b] + 1.0) * (total_t + buckets)))) for b in range(buckets)]
    scored = []
    for key, words, found in told:
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        scored.append((key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    able = sorted((r for r in scored if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = {}
    out = []
    for rank, r in enumerate(able, 1):
        out.append((*r[:4], rank if rank <= percent * len(able) // 100 else None))
    return out + [(*r[:4], None) for r in scored if r[4] < least]


def plain_order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize("segment_rows", [4096, 3])
def test_importance(spark, docs, edge_docs, no_docs, monkeypatch, segment_rows):
    monkeypatch.setattr(importance, "SEGMENT_ROWS", segment_rows)
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    texts = [r.text for r in target.select("text").collect()]
    long_words = " ".join(f"{'é' * (k % 50)}x{k}" for k in range(400))
    odd = docs.unionByName(edge_docs).unionByName(spark.createDataFrame([(None, long_words, None, None, 0), (None, long_words, None, None, 0), (7, "a b " * 30, None, None, 0)] + [(8, "same words here " * 20, None, None, 0)] * 40, SCHEMA))
    for frame in (docs, odd):
        found = importance.draw(frame.withColumn("weight", F.lit("x")).withColumn("SCORE", F.lit(1)), target)
        assert plain_order(map(tuple, found.collect())) == plain_order(plain_draw([(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()], texts))
    assert importance.draw(no_docs, target).collect() == []
    assert importance.draw(docs, no_docs, percent=100).where("rank IS NULL").where("n_features >= 39").count() == 0


def test_long_texts_are_cut_between_words(monkeypatch):
    text = " ".join(f"w{k % 89}" * (1 + k % 40) for k in range(3000)).encode()
    whole = [x for _, found in importance.features(text, importance.Known(), 1 << 31) for x in found]
    monkeypatch.setattr(importance, "STEP", 100)
    parts = [x for _, found in importance.features(text, importance.Known(), 1 << 31) for x in found]
    assert sorted(whole) == sorted(parts) and len(whole) == 5999
    monkeypatch.setattr(spellings, "STEP", 50)
    plain = text.decode().replace("1", "É")
    assert [w for part in spellings.runs(plain) for w in part] == re.findall("[a-zÀ-ÿ]+", plain)
