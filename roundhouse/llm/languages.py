"""Language of a text: its family first, then one-versus-one linear support vector machines between the family's languages.

Features are runs of 2 to 4 bytes of the lower-cased text, in which everything but letters is a space, as shares of all runs. A linear
machine's value is then a sum of looked-up weights over the text's runs, so whole texts are scored without building features.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.window import Window

from roundhouse.llm.shared import bound_batches, fresh
from roundhouse.llm.words import buffers

#: training rows of a language: those of the least hashed ids; learning needs no more, and every group that trains stays bounded
SAMPLE_PER_LANGUAGE = 400
SIZES = (2, 3, 4)
SLOTS = 1 << 16
#: bytes of text that are looked up at a time
STEP = 1 << 18
SCALE = 30.0
COST, EPOCHS = 4.0, 12
STEEPNESS = 4.0
UNKNOWN = "und"

# fixed values: families of languages by ISO 639-1 code; a code that isn't here is a family of its own
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "lb", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes}

LETTERS = np.full(256, 32, np.uint8)
LETTERS[97:123] = np.arange(97, 123)
LETTERS[65:91] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)


def family(language: str) -> str:
    return FAMILY_OF.get(language, f"of {language}")


def positions(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the runs that begin at each byte, one row for each size, and which of them count (inside a text, not only spaces)."""
    n = len(data)
    padded = np.concatenate([data, np.full(4, 32, np.uint8)]).astype(np.uint32)
    slots = np.empty((len(SIZES), n), np.int64)
    valid = np.empty((len(SIZES), n), bool)
    value, filled = padded[:n], data != 32
    for k in range(1, max(SIZES)):
        value = (value << np.uint32(8)) | padded[k : k + n]
        filled = filled | (padded[k : k + n] != 32)
        if k + 1 in SIZES:
            row = SIZES.index(k + 1)
            slots[row] = (value * np.uint32(2654435769) >> np.uint32(16)) + np.uint32(row * SLOTS)
            valid[row] = filled
            for back in range(1, k + 1):
                valid[row][ends[ends >= back] - back] = False
    return slots, valid


def stretches(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Texts as bytes in lower case, some at a time: first and last row, bytes, offsets. A very long text comes in overlapping parts of its own."""
    data, offsets = buffers(pc.utf8_lower(texts))
    row, n, overlap = 0, len(offsets) - 1, max(SIZES) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + STEP, "right")) - 1)
        begin, end = int(offsets[row]), int(offsets[stop])
        if end - begin <= STEP:
            yield row, stop, LETTERS[data[begin:end]], offsets[row : stop + 1] - begin
        else:
            for at in range(begin, end, STEP):
                part = LETTERS[data[at : min(end, at + STEP + overlap)]]
                yield row, stop, part, np.array([0, min(STEP, end - at)])
        row = stop


def summed(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """For each text and column of ``weights``, the mean weight of its runs times SCALE; nan where it has none."""
    total, count = np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts))
    for row, stop, data, offsets in stretches(texts):
        if not len(data):
            continue
        slots, valid = positions(data, offsets[1:] if len(data) == offsets[-1] else np.array([len(data)]))
        live = np.flatnonzero(offsets[:-1] < offsets[1:])
        starts = offsets[:-1][live]
        valid[:, offsets[-1] :] = False
        per_byte = valid.sum(axis=0)
        count[row + live] += np.add.reduceat(per_byte, starts)
        for c in range(weights.shape[1]):
            values = (weights[:, c][slots] * valid).sum(axis=0, dtype=np.float64)
            total[row + live, c] += np.add.reduceat(values, starts)
    with np.errstate(invalid="ignore", divide="ignore"):
        return total / count[:, None] * SCALE


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots of a training text and their values."""
    slots = [s[v] for _, _, data, offsets in stretches(pa.array([text])) for s, v in [positions(data, np.array([len(data)]))]]
    found, counts = np.unique(np.concatenate(slots), return_counts=True) if slots else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return found.astype("<i4"), (counts / max(1, counts.sum()) * SCALE).astype("<f4")


def train(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray) -> np.ndarray:
    """Weights (the last one the bias) of a linear machine with hinge loss, by dual coordinate ascent."""
    weights = np.zeros(len(SIZES) * SLOTS + 1)
    alpha, norms = np.zeros(len(rows)), np.array([float(v @ v) + 1 for _, v in rows])
    rng = np.random.default_rng(11)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            slots, values = rows[i]
            gradient = signs[i] * (weights[slots] @ values + weights[-1]) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), COST)
            step = (new - alpha[i]) * signs[i]
            if step:
                weights[slots] += step * values
                weights[-1] += step
                alpha[i] = new
    return weights


def held_out(id_col: str) -> Column:
    """Rows never learned from: CRC-32 of the id as text leaves 2 when divided by 4. A null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Model:
    """Machines between families and, in each family, between its languages."""

    def __init__(self, languages: list[str], machines: dict[tuple[str, str], np.ndarray]):
        self.languages = sorted(languages)
        self.families = sorted({family(x) for x in languages})
        self.pairs = sorted(machines)
        self.places = {pair: place for place, pair in enumerate(self.pairs)}
        size = len(SIZES) * SLOTS
        self.weights = np.stack([machines[p][:size] for p in self.pairs], axis=1).astype(np.float32) if self.pairs else np.zeros((size, 0), np.float32)
        self.bias = np.array([machines[p][size] for p in self.pairs])

    def choose(self, names: list[str], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Winner's number among ``names`` by votes, then by margins, and how sure its closest decision was."""
        votes, sums, least = (np.zeros((len(margins), len(names))) for _ in range(3))
        least += np.inf
        for a, b in itertools.combinations(range(len(names)), 2):
            if (names[a], names[b]) not in self.places:  # neither side had an example
                continue
            m = margins[:, self.places[names[a], names[b]]]
            for k, v in ((a, m), (b, -m)):
                votes[:, k] += v > 0
                sums[:, k] += v
                least[:, k] = np.minimum(least[:, k], v)
        best = np.lexsort((sums, votes), axis=1)[:, -1] if len(margins) else np.zeros(0, int)
        closest = np.minimum(least[np.arange(len(best)), best], 50.0)
        return best, 1 / (1 + np.exp(-STEEPNESS * closest))

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        margins = np.nan_to_num(summed(texts, self.weights)) + self.bias if self.pairs else np.zeros((len(texts), 0))
        chosen, sure = self.choose(self.families, margins)
        out, score = np.empty(len(texts), object), np.empty(len(texts))
        for k, name in enumerate(self.families):
            own = np.flatnonzero(chosen == k)
            members = [x for x in self.languages if family(x) == name]
            best, inner = self.choose(members, margins[own])
            out[own] = np.array(members, object)[best]
            score[own] = sure[own] * inner
        return out.tolist(), score


def least_hashed(rows: DataFrame, most: int) -> DataFrame:
    """Of ``i, l`` the ``most`` rows of the least hashes for each ``l``, without repeats.

    Hashes are counted in steps that widen with the hash, an eighth of a power of two each, so the steps that reach ``most`` rows hold few
    more than that, however many rows or tasks there are; only those rows move.
    """
    step = F.floor(F.log2(F.xxhash64("i").cast("double") + (2.0**63 + 1)) * 8)
    counts = rows.groupBy("l", step.alias("step")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("l").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = counts.withColumn("before", before).where(F.col("before") < most).groupBy("l").agg(F.max("step").alias("last"))
    near = rows.join(F.broadcast(last), "l").where(step <= F.col("last"))
    rank = F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64("i"), "i"))
    return near.withColumn("rank", rank).where(F.col("rank") <= most).select("i", "l").distinct()


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model of every language that rows with a letter outside the held-out part are labelled with, or None if there is none."""
    bound_batches(docs.sparkSession)
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), F.col(text_col).alias("text"))
    labelled = labelled.where(F.regexp_like("text", F.lit(r"\p{L}")))
    chosen = least_hashed(labelled.select("i", "l"), SAMPLE_PER_LANGUAGE)
    sample = labelled.join(F.broadcast(chosen), ["i", "l"])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, name, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                rng = np.random.default_rng(abs(hash(len(text))))
                words = text.split()
                at = int(rng.integers(0, max(1, len(words) - 4)))
                for part in (text, " ".join(words[at : at + 4])):  # a few words too, for short texts
                    slots, values = features(part)
                    if len(slots):
                        yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([str(i)], pa.string()), pa.array([slots.tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], names=["l", "i", "slots", "vals"])

    languages = sorted(r[0] for r in chosen.select("l").distinct().collect())
    if not languages:
        return None
    by_family = sorted({family(x) for x in languages})
    machines = [(a, b, x, 1 if family(x) == a else -1) for a, b in itertools.combinations(by_family, 2) for x in languages if family(x) in (a, b)]
    machines += [(a, b, x, 1 if x == a else -1) for a, b in itertools.combinations(languages, 2) if family(a) == family(b) for x in (a, b)]
    if not machines:
        return Model(languages, {})
    roles = docs.sparkSession.createDataFrame(machines, "a string, b string, l string, sign int")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["l", "i", "slots"])
        examples = [(np.frombuffer(s, "<i4"), np.frombuffer(v, "<f4").astype(float)) for s, v in zip(rows["slots"], rows["vals"])]
        weights = train(examples, rows["sign"].to_numpy(float))
        return pd.DataFrame({"a": [rows["a"].iloc[0]], "b": [rows["b"].iloc[0]], "weights": [weights.astype("<f4").tobytes()]})

    examples = sample.mapInArrow(extract, "l string, i string, slots binary, vals binary").join(F.broadcast(roles), "l")
    fitted = examples.groupBy("a", "b").applyInPandas(fit, "a string, b string, weights binary").collect()
    return Model(languages, {(r.a, r.b): np.frombuffer(r.weights, "<f4") for r in fitted})


def prediction(model: Model | None, text: Column) -> Column:
    """Struct ``lang, score`` of a text; null text, or text without a letter, is ``und`` with score 0."""

    @arrow_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            found = [UNKNOWN] * len(batch), np.zeros(len(batch))
            if model:
                found = model.predict(batch)
            yield pa.StructArray.from_arrays([pa.array(found[0], pa.string()), pa.array(found[1], pa.float64())], ["lang", "score"])

    letters = F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False))
    nothing = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    # called non-deterministic, so that a filter on the result isn't moved below it, where it would be computed again
    return F.when(letters, run.asNondeterministic()(text)).otherwise(nothing)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row, by a model of the same table's labelled rows.

    Without labelled rows that hold a letter every text is ``und``. Rows that repeat an id are predicted each for itself. An empty table gives no rows.
    """
    model = learn(docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), prediction(model, F.col(text_col)).alias("p"))
    return rows.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose language could be told, with all their columns; a null language is filled by the prediction.

    Null texts and texts without a letter go, and without labelled rows all. Rows that repeat an id, and those without one, are told each for
    itself. An empty table gives no rows.
    """
    model = learn(docs, id_col, text_col, lang_col)
    (found,) = fresh(docs.columns, "found")
    told = docs.withColumn(found, prediction(model, F.col(text_col))["lang"]).where(F.col(found) != UNKNOWN)
    return told.withColumn(lang_col, F.coalesce(lang_col, found)).select(*docs.columns)
