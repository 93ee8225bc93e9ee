"""Phrases, neighbours, templates, languages, mixtures and the pipeline against plain versions."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_edges import SCHEMA
from pyspark.sql import functions as F

import corpus_pipeline
from roundhouse.llm import languages, mixing, neighbours, phrases, templates
from roundhouse.llm.queries import domain, target


def plain_phrases(rows, length):
    docs = [(i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    seen = Counter(tuple(w[k : k + length]) for _, w in docs for k in range(len(w) - length + 1))
    out = []
    for i, w in docs:
        gone = set()
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k : k + length])] > 1:
                gone.update(range(k, k + length))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out)


def test_phrases(spark, edge_docs, no_docs):
    inner = " ".join(["spam"] * 50)  # a passage that recurs in itself
    rng = np.random.default_rng(0)
    words = [f"t{i}" for i in rng.integers(0, 40, 400)]
    mixed = spark.createDataFrame([(1000 + k, " ".join(words[a:b]), None, None, None) for k, (a, b) in enumerate([(0, 100), (50, 200), (64, 99), (65, 99), (180, 400), (0, 100)])] + [(2000, inner, None, None, None)], SCHEMA)
    for frame, length in ((edge_docs, 35), (mixed, 35), (mixed, 9)):
        rows = phrases.digests(frame, length).collect()
        assert sorted(tuple(r) for r in rows) == plain_phrases([(r.doc_id, r.text) for r in frame.collect()], length)
    assert phrases.digests(no_docs).collect() == []


def test_phrases_by_automata(spark, monkeypatch):
    """Many shards, some in pieces, give the same rows; a passage that no automaton holds is not removed."""
    words = [f"t{i}" for i in np.random.default_rng(3).integers(0, 300, 500)]
    rows = [(1, " ".join(words)), (2, "a b c " + " ".join(words[:120]) + " d " + " ".join(words[200:330])), (3, " ".join(words[60:260])), (4, "x " * 50), (None, " ".join(words[400:]))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    wanted = plain_phrases([(i or 0, t) for i, t in rows], 35)

    def found():
        return sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in phrases.digests(frame, 35).collect())

    monkeypatch.setattr(phrases, "SHARD", 2)
    assert found() == wanted
    dealt = phrases.dealt
    monkeypatch.setattr(phrases, "dealt", lambda proposed, shards, path: dealt(proposed.where("NOT startswith(decode(words, 'UTF-8'), 'x ')"), shards, path))
    left = {i: n for i, _, n, _ in found()}
    assert left[4] == 0 and {i: n for i, n in left.items() if i != 4} == {i: n for i, _, n, _ in wanted if i != 4}
    monkeypatch.setattr(phrases, "dealt", lambda proposed, shards, path: dealt(proposed.where("false"), shards, path))
    assert not any(n for _, _, n, _ in found())


def test_phrases_pieces_once(spark, monkeypatch, tmp_path):
    """A shard's automata are made once for many batches of stretches, not once for each batch."""
    words = [f"t{i}" for i in range(100)]
    listed = [(k, 0, " ".join(words[k : k + 35]).encode()) for k in range(10)]
    folder = phrases.dealt(spark.createDataFrame(listed, "id bigint, anchor bigint, words binary").coalesce(1), 1, f"file://{tmp_path}/dealt")
    log, made = str(tmp_path / "made"), phrases.automaton

    def counted(passages):
        with open(log, "a") as file:
            file.write("x")
        return made(passages)

    monkeypatch.setattr(phrases, "automaton", counted)
    parts = [(r, 0, 5, " ".join([*words[:40], "?", *words[1:36]]).encode()) for r in range(200)]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10")
    try:
        found = phrases.located(spark.createDataFrame(parts, "row bigint, shard int, begin bigint, words binary").coalesce(1), folder, 35, 4).collect()
    finally:
        spark.conf.set(name, before)
    hits = sorted((x.row, i, at) for x in found for i, at in zip(x.ids, x.at))
    assert hits == sorted((r, i, at) for r in range(200) for i, at in [*((k, 5 + k) for k in range(6)), (1, 46)])
    with open(log) as file:
        assert len(file.read()) == 3


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    vectors = [[float(x) for x in np.float32(centres[i % 12] * (1 + i % 3) + rng.normal(size=16) * 0.4)] for i in range(900)]
    vectors[100] = vectors[300] = vectors[500] = vectors[20]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None] * 8, [float("inf")] + [0.0] * 15, [1.0, 2.0, 3.0], [2.0, 1.0, 0.5]]
    rows = list(enumerate(vectors)) + [(2000 + 20 * k, v) for k, v in enumerate(odd)] + [(20, vectors[20])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    found = neighbours.nearest(frame, k=20, every=20, shard_rows=256).collect()
    good = {i: np.array(v, np.float64) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    wanted = {q: sorted(((-(good[q] @ v), i) for i, v in good.items() if i != q and len(v) == len(good[q])))[:20] for q in good if q % 20 == 0}
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(got[r.query_id]) + 1
        assert r.score == pytest.approx(good[r.query_id] @ good[r.vec_id], rel=1e-12)
        got[r.query_id].append((-r.score, r.vec_id))
    assert set(got) == {q for q, w in wanted.items() if w}
    hits = sum(len({i for _, i in wanted[q]} & {i for _, i in got[q]}) for q in got)
    assert hits >= 0.95 * sum(map(len, wanted.values())) and all(len(got[q]) == len(wanted[q]) and got[q] == sorted(got[q]) for q in got)
    assert neighbours.nearest(frame.where("vec_id < 0")).collect() == []


def test_recall_on_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    local = table.toPandas()
    matrix = np.stack(local.embedding).astype(np.float64)
    found = neighbours.nearest(table, shard_rows=512).toPandas().groupby("query_id").vec_id.apply(set)
    hits = []
    for q, ids in found.items():
        scores = matrix @ matrix[local.vec_id == q][0]
        scores[local.vec_id == q] = -np.inf
        hits.append(len(ids & set(local.vec_id[np.argsort(-scores)[:20]])) / 20)
    assert np.mean(hits) >= 0.95


@pytest.mark.parametrize("kind", ["float", "double"])
def test_recall_of_registered_settings(spark, kind):
    """Normally distributed vectors, the hardest to search, in one graph of the largest size; scores to the last digit."""
    rng = np.random.default_rng(3)
    matrix = rng.normal(size=(neighbours.SHARD_ROWS, 64))
    matrix = matrix.astype(np.float32).astype(np.float64) if kind == "float" else matrix
    frame = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(matrix)], f"vec_id bigint, embedding array<{kind}>, shard string")
    found = neighbours.nearest(frame).toPandas()
    scores = matrix[::20] @ matrix.T
    scores[np.arange(len(scores)), np.arange(len(scores)) * 20] = -np.inf
    best = np.argsort(-scores, axis=1)[:, :20]
    by_query = found.groupby("query_id").vec_id.apply(set)
    assert len(by_query) == len(scores) and len(found) == 20 * len(scores)
    assert np.mean([len(by_query[20 * k] & set(b)) / 20 for k, b in enumerate(best)]) >= 0.95
    assert np.allclose(found.score, (matrix[found.query_id] * matrix[found.vec_id]).sum(1), rtol=1e-12, atol=1e-12)


PAGE = """<!DOCTYPE html><html><head><title>t &amp; u</title><style>p{}</style><script>var x="</p><article>";</script></head><body class="home">
<header>Site</header><nav><ul><li><a href="/a">Menu {n}</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy {n}</div>
<{tag} class="{cls}"><h1>Head&nbsp;line &lt;{n}&gt;</h1><p>One <b>bo</b>ld &eacute;<br>two {n}<p>Three<div class="comments"><p>first!</p></div></{tag}>
<form><p>mail</p></form><aside>side</aside><div class="cookie-notice">cookies</div><footer>&copy; all rights {n}</footer></body></html>"""
TEXT = "Head line <{n}> One bold é two {n} Three"


def test_pages(spark):
    rows = [(i, f"https://{'a' if i % 3 else 'B'}.example.org/{i}?x", PAGE.replace("{tag}", "article").replace("{n}", str(i)).replace("{cls}", "x")) for i in range(30)]
    rows += [(100 + i, f"http://plain.example.org:80/{i}", PAGE.replace("{tag}", "div").replace("{n}", str(i)).replace("{cls}", "story")) for i in range(20)]
    rows += [(200, None, None), (201, "", ""), (202, "x", "just text"), (203, "http://c.org/", "<p>open <b>and &am"), (204, "http://c.org/", "<article>" + "<p>w</p>" * 30_000), rows[0]]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("Host_", F.lit(1))
    out = templates.extract(frame)
    got = {r.page_id: r.main_text for r in out.collect()}
    assert out.columns == [*frame.columns, "main_text"] and out.count() == len(rows)
    for i in range(30):
        assert got[i] == TEXT.replace("{n}", str(i))
    for i in range(20):
        assert got[100 + i] == TEXT.replace("{n}", str(i))
    assert (got[200], got[201], got[202], got[203]) == ("", "", "just text", "open and &am") and got[204] == " ".join(["w"] * 30_000)
    assert templates.extract(frame.where("page_id < 0")).collect() == []


def texts_of(spark, pages):
    """Main texts of (url, html), in order."""
    frame = spark.createDataFrame([(k, *p) for k, p in enumerate(pages)], "page_id bigint, url string, html string")
    return [r.main_text for r in templates.extract(frame).orderBy("page_id").collect()]


def test_template_decides_inside_articles(spark):
    notice = "<p>Share this story with the people you know</p>"
    pages = [(f"http://n.org/{k}", f"<body><article><h1>T{k}</h1><p>Story{k} of this page</p>{notice if k else ''}<p>End{k}</p><div class=x>Sent to you by us</div></article></body>") for k in range(12)]
    cards = "<article><h2>Card {k}</h2></article><article><h2>Tease {k}</h2></article>"
    pages += [(f"http://c.org/{k}", f"<body><div class=text><p>{f'story{k} ' * 30}</p></div>{cards.replace('{k}', str(k))}</body>") for k in range(12)]
    got = texts_of(spark, pages)
    assert got[:12] == [f"T{k} Story{k} of this page End{k}" for k in range(12)]
    assert all(f"story{k} story{k}" in got[12 + k] for k in range(12))


def test_template_classes_nest():
    def token(path, token, words, vector):
        return {"path": path, "token": token, "words": words, "vector": vector, "count": 12}

    tree = [token("", 0, 0, "1"), token("a", 1, 0, "1"), token("a>b", 2, 0, "2"), token("a>c", 3, 0, "3")]
    # equal vectors in two slots: neither is large enough by itself
    assert templates.template([*tree, token("a>b", 4, 1, "9"), token("a>b", 5, 1, "9"), token("a>c", 6, 1, "9")]) == []
    assert templates.template([*tree, token("a>b", 4, 1, "9"), token("a>b", 5, 2, "9"), token("a>c", 6, 1, "9")]) == [4, 5]


def test_article_root_keeps_nested_parts(spark):
    def side(k):
        return f"<div class=more><p><a href=/1>other{k} one</a></p><p><a href=/2>other{k} two</a></p></div>"

    def nested(k):
        return f"<body>{side(k)}<div class=story><h1>Title{k}</h1><p>Lead{k} here</p><section class=a><p>{f'a{k} ' * 60}</p></section><section class=b><p>{f'b{k} ' * 3}</p></section></div></body>"

    def items(k):
        return f"<body>{side(k)}<div class=text><p>Before{k}</p><ul>{''.join(f'<li>item{k}x{i} of the list</li>' for i in range(20))}</ul><blockquote>Said{k}</blockquote><table><tr><td>cell{k}</td></tr></table></div></body>"

    def apart(k):
        return f"<body>{side(k)}<h1>Title{k}</h1><p><a href=/by>author</a></p><p>Lead{k} here</p><div class=text><p>{f'a{k} ' * 90}</p></div>{side(k) * 3}</body>"

    makers = [nested, items, apart]
    wanted = [
        lambda k: f"Title{k} Lead{k} here " + " ".join([f"a{k}"] * 60 + [f"b{k}"] * 3),
        lambda k: f"Before{k} " + " ".join(f"item{k}x{i} of the list" for i in range(20)) + f" Said{k} cell{k}",
        lambda k: f"Title{k} Lead{k} here " + " ".join([f"a{k}"] * 90),
    ]
    # three layouts on one host, and the same without a host
    pages = [(url and f"{url}/{k}", makers[k % 3](k)) for url in ("http://three.org", None) for k in range(24)]
    assert texts_of(spark, pages) == [wanted[k % 3](k) for _ in range(2) for k in range(24)]


@pytest.mark.parametrize("name", ["no-sidebar", "has-sidebar", "comments-open", "social-issues", "search-results", "sidebar", "comments"])
@pytest.mark.parametrize("tag", ["body", "main", "article"])
def test_marks_spare_whole_pages(tag, name):
    page = "<html><body><main><article><h1>Title</h1><p>Story</p></article></main></body></html>".replace(f"<{tag}>", f'<{tag} class="{name}">')
    assert templates.main_text(page) == "Title Story"


def test_marks_spare_the_article():
    story = "the story goes on " * 20
    parts = f'<div class="entry-header"><h1>Title</h1></div><header><p>By me</p></header><p>{story}</p><figure><pre>x = 1</pre><figcaption>Caption</figcaption></figure>'
    parts += '<p>Sum <math><mi>a</mi><mo>+</mo><mn>2</mn><annotation>a+2</annotation></math> here</p><noscript><p>Still</p></noscript>'
    whole = f"Title By me {story}x = 1 Caption Sum a+2 here Still"
    outside = '<header>Site</header><noscript>Scripts</noscript><div class="site-header">Name</div><div class="x share-buttons">Share</div><div id="cookie_notice">Cookies</div>'
    for tag in ("article", "main", "div class=story", "form", "div class=comments"):
        assert templates.main_text(f"<head><body class=home>{outside}<{tag}>{parts}</{tag.split()[0]}><nav><p>{story * 3}</p></nav></body>") == whole, tag
    # an advertisement that is longer than the article
    assert templates.main_text(f'<body><div class="ad">{story}</div><article><p>Short.</p></article></body>') == "Short."
    # a title's header beside the text that holds nearly all
    assert templates.main_text(f"<body>{outside}<div class=post><header class=post-header><h1>Title</h1></header><div><p>{story}</p></div></div></body>") == f"Title {story}".strip()


def test_spark_hash(spark):
    for a, b in (("html>body", "word"), ("", "é" * 40), ("x" * 100, "")):
        assert templates.spark_hash(a, b) == spark.range(1).select(F.xxhash64(F.lit(a), F.lit(b))).first()[0]


def test_languages(docs, edge_docs, no_docs):
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = languages.identify(docs).collect()
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    texts = {r.doc_id: r.text for r in edge_docs.collect()}
    for r in languages.identify(edge_docs).collect():
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or ""))
    assert languages.identify(no_docs).collect() == []
    assert {r.lang_pred for r in languages.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_long_text_is_scored_in_parts(monkeypatch):
    import pyarrow as pa

    weights = np.random.default_rng(0).normal(size=(len(languages.SIZES) * languages.SLOTS, 2)).astype(np.float32)
    texts = pa.array(["Ein langer Text, mit Wörtern " * 40, "a", "", None, "zwei"])
    whole = languages.summed(texts, weights)
    monkeypatch.setattr(languages, "STEP", 100)
    assert np.allclose(whole, languages.summed(texts, weights), equal_nan=True)


def test_shares():
    assert mixing.share_out(100, [(1, 1000), (1, 1000)]) == [50, 50]
    assert mixing.share_out(100, [(3, 10), (1, 1000), (0, 50)]) == [10, 90, 0]
    assert mixing.share_out(100, [(1, 5), (1, 6)]) == [5, 6]
    assert sum(mixing.share_out(101, [(1, 50), (1, 50), (1, 50)])) == 101
    held = {("a", "x", "1"): 10, ("a", "x", "2"): 100, ("a", "y", "3"): 100, ("b", "x", "4"): 1000}
    given = mixing.budgets(held, lambda path: 1.0, 200)  # a's shortage stays with its sibling source
    assert given == {("a", "x", "1"): 10, ("a", "x", "2"): 40, ("a", "y", "3"): 50, ("b", "x", "4"): 100}
    assert mixing.budgets(held, lambda path: 1.0, 600)[("b", "x", "4")] == 390  # the whole branch is spent


@pytest.mark.parametrize("bits", [3, 14])
def test_mixture(docs, edge_docs, no_docs, monkeypatch, bits):
    monkeypatch.setattr(mixing, "RANGE_BITS", bits)
    for frame in (docs, edge_docs):
        rows = mixing.mix(frame, domain(), target, 0.7, 2, seed=3).withColumn("d", domain()).withColumn("h", F.xxhash64(F.lit(3), "doc_id")).withColumn("n", mixing.tokens_of(F.col("text"))).collect()
        leaves = defaultdict(list)
        for r in rows:
            leaves[r.d, r.lang or "", r.source or ""].append(r)
        held = {k: sum(r.n for r in v) for k, v in leaves.items()}
        given = mixing.budgets({k: 2 * v for k, v in held.items()}, target, round(0.7 * sum(held.values())))
        for k, v in leaves.items():
            whole, rest = divmod(given[k], max(1, held[k]))
            at = 0
            # hash order as unsigned, then signed inside a range
            for r in sorted(v, key=lambda r: ((r.h & (1 << 64) - 1) >> (64 - bits), r.h, r.doc_id)):
                assert r.copies == whole + (at < rest), (k, r)
                at += r.n
    assert mixing.mix(no_docs, domain(), target, 0.5).collect() == []


def test_pipeline(spark, docs, tmp_path):
    docs.withColumn("text", F.when(F.col("doc_id") % 50 == 3, None).when(F.col("doc_id") % 50 == 4, "12 !").otherwise(F.col("text"))).write.parquet(f"{tmp_path}/documents.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id for r in frame.select("doc_id").collect()}
    assert kept["language_id"] == {i for i in range(200) if i % 50 not in (3, 4)}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/language_id").collect()}
    assert kept["exact_dedup"] == {max(i for i in texts if texts[i] == t) for t in set(texts.values())}
    assert kept["near_dedup"] <= kept["exact_dedup"] and kept["packing"] == kept["mixture"] <= kept["near_dedup"]
    assert len(kept["mixture"]) >= 0.8 * len(kept["near_dedup"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == frame.count()


def test_pipeline_edges(spark, docs, edge_docs, no_docs, tmp_path):
    """Empty, repeated, null and clashing: every stage takes what the one before kept."""
    extra = edge_docs.withColumn("Found", F.lit(1)).withColumn("slot", F.lit(2)).withColumn("gone_id", F.lit(3)).withColumn("rank", F.lit(4)).withColumn("tokens_", F.lit(5))
    nulls = extra.where("doc_id < 12").withColumn("doc_id", F.lit(None).cast("bigint"))
    for name, frame in (("none", no_docs), ("edges", extra.unionAll(nulls).unionAll(extra.where("doc_id = 30")))):
        counts = []
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, frame, str(tmp_path))
            assert k == 4 or out.columns == frame.columns
            out.write.parquet(f"{tmp_path}/{name}{k}")
            frame = spark.read.schema(out.schema).parquet(f"{tmp_path}/{name}{k}")
            counts.append(frame.count())
        assert (name == "none") == (sum(counts) == 0) and counts[:4] == sorted(counts[:4], reverse=True)
    kept = spark.read.parquet(f"{tmp_path}/edges1").groupBy("text").count().collect()
    assert all(r["count"] == 1 for r in kept) and len(kept) == edge_docs.where(r"text RLIKE '\\p{L}'").select("text").distinct().count()


def test_null_languages_are_filled(docs):
    some = docs.withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.col("lang"))).withColumn("FOUND", F.lit(0))
    told = {r.doc_id: r.lang for r in languages.identified(some).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert set(told) == set(truth) and all(told[i] == truth[i] for i in truth if i % 3)
    filled = [i for i in truth if i % 3 == 0]
    assert sum(told[i] == truth[i] for i in filled) >= 0.95 * len(filled)


@pytest.mark.parametrize("most", [1, 7, 400])
def test_least_hashed(spark, most):
    rows = spark.createDataFrame([(i % 900, "ab"[i % 3 == 0]) for i in range(3000)], "i bigint, l string").repartition(7)
    order = languages.Window.partitionBy("l").orderBy(F.xxhash64("i"), "i")
    plain = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("i", "l").distinct()
    assert sorted(plain.collect()) == sorted(languages.least_hashed(rows, most).collect())


def test_languages_without_a_letter_are_left_out(spark):
    rows = [(i, t, n, None, None) for i, (t, n) in enumerate([("1 2 3", "en"), ("...", "de"), ("4", "fr"), ("hello there friend", "en"), ("the dog runs", "en"), ("77", "ru"), ("88", "uk")] * 8)]
    found = languages.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.lang_pred for r in found} == {"en", "und"}
    numbers = spark.createDataFrame([(i, "1 2", n, None, None) for i, n in enumerate(["en", "de", "ru"] * 9)], SCHEMA)
    assert {r.lang_pred for r in languages.identify(numbers).collect()} == {"und"}
