"""Registered queries of the operators, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roundhouse.llm import chat, exact_dedup, importance, languages, minhash, mixing, neighbours, packing, phrases, separators, spellings, templates, token_files_zstd
from roundhouse.llm.shared import Scratch
from roundhouse.llm.tokens import BYTE_BPE, WORD_BPE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document in sequences of 2048 ids."""
    pieces = packing.pack(table(spark, folder, "documents"), BYTE_BPE, end_id=1, window=2048, plain=False)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op3_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without passages of 35 words that recur."""
    return phrases.digests(table(spark, folder, "documents"), length=35)


ORACLES["op3_phrases"] = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM docs WHERE len(w) >= 35)),
again AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
covered AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM windows SEMI JOIN again USING (h)),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN covered USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""


@query
def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document, counted by the separators in flat files."""
    return separators.count_documents(table(spark, folder, "documents"), Scratch(spark, "flat-ids").folder, BYTE_BPE, end_id=50256)


@query
def op5_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate groups of all documents on two-word runs."""
    return minhash.near_duplicates(table(spark, folder, "documents"), words=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


ORACLES["op5_minhash"] = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM docs WHERE len(w) > 1)
  UNION ALL SELECT doc_id, w[1] FROM docs WHERE len(w) = 1),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
reached AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reached r JOIN links l ON l.x = r.y)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(y) AS component_id, d.doc_id = min(y) AS kept
FROM documents d JOIN reached ON x = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id, n
"""


@query
def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of equal texts; the largest id stays."""
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"))


ORACLES["op8_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query
def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's ids, written to compressed files with a shared dictionary and read back."""
    manifest = token_files_zstd.write(table(spark, folder, "documents"), Scratch(spark, "tokz-files").folder, WORD_BPE, end_id=2, plain=False)
    back = token_files_zstd.read(spark, manifest)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op2_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth, by inner product."""
    return neighbours.nearest(table(spark, folder, "embeddings"), k=20, every=20)


@query
def op6_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    found = templates.extract(table(spark, folder, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("bigint").alias("n_chars"))


@query
def op7_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document."""
    return languages.identify(table(spark, folder, "documents"))


def domain() -> Column:
    """Domain of a document in the example mixture: sources by their number (fixed values), others apart."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), r"^src(\d+)$", 1)
    return F.when(number == "", "other").when(number.cast("int") == 0, "crawl").when(number.cast("int") % 2 == 0, "books").otherwise("forums")


#: target weights of the example mixture; languages and sources that aren't named have weight 1
WEIGHTS = {("crawl",): 4.0, ("books",): 3.0, ("forums",): 2.0, ("other",): 1.0, ("crawl", "en"): 2.0, ("books", "en"): 2.0, ("forums", "en"): 2.0, ("books", "de", "src2"): 3.0}


def target(path: tuple[str, ...]) -> float:
    return WEIGHTS.get(path, 1.0)


@query
def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """How often each document is taken into a mixture of 0.8 of the corpus's tokens, at most two epochs of a source."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    mixed = mixing.mix(docs, domain(), target, share=0.8, max_epochs=2, seed=10)
    return mixed.select("doc_id", "lang", "source", "copies")


@query
def op11_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of all conversations, read back from their examples; conversation -1 says control strings."""
    said = "</s>[INST] ok [/INST]"
    odd = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd)
    return chat.read_back(chat.examples(rows))


ORACLES["op11_chat"] = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length('<|im_start|><|im_sep|><|im_end|>') + length(role) + length(text)
    + len(regexp_extract_all(role || chr(10) || text, '<\\*(\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|SYS>>|/SYS>>)|\[\\*(INST\]|/INST\])')) AS size
  FROM said),
placed AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS many, sum(size) OVER w AS upto
  FROM sized WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(upto) FILTER (role = 'assistant' OR i = many)::BIGINT AS formatted_chars
FROM placed GROUP BY conv_id
"""


@query
def op12_spellings(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all documents with their near words and the form they stand for."""
    return spellings.variants(table(spark, folder, "documents"), least_length=5, least_count=3, ratio=2, damage=97)


@query
def op13_importance(spark: SparkSession, folder: str) -> DataFrame:
    """A quarter of the documents, drawn by how much they look like the benchmark."""
    return importance.draw(table(spark, folder, "documents"), table(spark, folder, "benchmark"), percent=25, least_words=20, buckets=10_000, seed=7)
