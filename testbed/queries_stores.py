"""Queries on stores and sinks: split and appended feature tables, sparse vectors, metadata of any shape, checked streams, samples."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from roundhouse import BoardEncoder
from roundhouse import dims as dimensions
from roundhouse.operators import sample
from roundhouse.plans import extract, score, train
from roundhouse.plans.catalog import build_catalog
from roundhouse.sources import rounds as sources
from roundhouse.sources.features import read_features
from roundhouse.streaming.scorer import ROUND_ID, read_quarantine, read_scores, stream_checked
from testbed import adapter
from testbed.adapter import dims
from testbed.queries_jobs import CHANCE, NAMED, SCORED, SUMS, folder, rounded, scorer, stored_rounds
from testbed.queries_rounds import BAD_UNITS, CUTS, usable_nested
from testbed.queries_vectors import WIDE, wide_ctes
from testbed.registry import COL_SQL, COPIES, NENRICHED, NESTED, REACHED, ROW_SQL, query

# -- feature stores ------------------------------------------------------------------------------------------------------


@query(
    "split_features_job",
    f"""{NESTED}{NAMED}, ranked AS (SELECT round_key, outcome, row_number() OVER (ORDER BY ts) - 1 AS r FROM nusable), cut AS (SELECT {CUTS} FROM nusable)
    SELECT round_idx, cast(outcome AS bigint) AS outcome, CASE WHEN r < a THEN 'train' WHEN r < a + b THEN 'val' ELSE 'test' END AS split
    FROM ranked JOIN named USING (round_key), cut""",
)
def split_features_job(spark, d):
    """Features written with a folder for each split, each read back from its own folder."""
    raw = stored_rounds(spark, d)
    extract.extract_sparse_features(spark, raw, f"{raw}-features", dims())
    extract.split_features(spark, f"{raw}-features", f"{raw}-split")
    parts = [read_features(spark, f"{raw}-split").filter(F.col("split") == name) for name in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("round_idx", F.col("outcome").cast("bigint").alias("outcome"), "split")


@query("append_extract", f"{NESTED}{NAMED} SELECT round_idx, cast(outcome AS bigint) AS outcome, ts AS timestamp FROM nusable JOIN named USING (round_key)")
def append_extract(spark, d):
    """Three chunks of raw files, one after another, the last one twice; keys are those of one whole extraction."""
    raw = stored_rounds(spark, d)
    rows = sources.read_rounds(spark, raw)
    edges = [(None, 800_000_000_000), (800_000_000_000, 850_000_000_000), (850_000_000_000, None)]
    for number, (low, high) in enumerate(edges):
        part = rows.filter(F.col("timestamp") >= low) if low else rows
        (part.filter(F.col("timestamp") < high) if high else part).write.parquet(f"{raw}-{number}")
    for number in (0, 1, 2, 2):
        extract.extract_sparse_features(spark, f"{raw}-{number}", f"{raw}-features", dims(), chunk=f"chunk{number}")
    return read_features(spark, f"{raw}-features").select("round_idx", F.col("outcome").cast("bigint").alias("outcome"), "timestamp")


@query(
    "sparse_wide_features",
    f"""{NESTED}{NENRICHED}{COPIES}{REACHED.format(counts='copies')}{wide_ctes('nusable')}
    SELECT round_key, feature, value FROM (UNPIVOT wide ON COLUMNS(* EXCLUDE (round_key)) INTO NAME feature VALUE value) WHERE value <> 0""",
)
def sparse_wide_features(spark, d):
    """What isn't zero in the sparse vector that tabular models train on."""
    encoder = BoardEncoder(dims())
    player, opponent = F.col("player_board"), F.col("opponent_board")
    costs = [encoder.total_cost(side).alias(name) for side, name in ((player, WIDE[-2]), (opponent, WIDE[-1]))]
    rows = usable_nested(spark, d).select("round_key", encoder.wide_words(player, opponent).alias("words"), *costs)
    vectors = PipelineModel(train.wide_stages(rows, WIDE)).transform(rows)
    entries = vectors.select("round_key", F.posexplode(vector_to_array("features")).alias("place", "value")).filter("value <> 0")
    return entries.select("round_key", F.get(F.array(*map(F.lit, WIDE)), F.col("place")).alias("feature"), F.col("value").cast("bigint").alias("value"))


# -- scores --------------------------------------------------------------------------------------------------------------

MODEL_SCALES = {"vit": 20.0, "cnn": 10.0, "xgboost": 40.0}
MODEL_ROWS = ", ".join(f"('{name}', {scale})" for name, scale in MODEL_SCALES.items())


@query(
    "score_all_models",
    f"""{NESTED}{NENRICHED}, costs AS (SELECT round_key, {SUMS} FROM enriched GROUP BY round_key)
    SELECT round_key, model, {SCORED.format(p=CHANCE.format(scale='scale'))}
    FROM nusable JOIN costs USING (round_key), (VALUES {MODEL_ROWS}) m(model, scale)""",
)
def score_all_models(spark, d):
    boards = usable_nested(spark, d).select("round_key", "player_board", "opponent_board")
    return rounded(score.score_boards(boards, {name: scorer(scale) for name, scale in MODEL_SCALES.items()}, dims()))


BROKEN = f""", placed AS (SELECT n.round_key, team, tier, {ROW_SQL} AS r, {COL_SQL} AS c FROM nunits n JOIN nusable USING (round_key)),
    found AS (
      SELECT round_key, team || '.tier' AS v FROM placed WHERE coalesce(tier, 1) NOT BETWEEN 1 AND 4
      UNION SELECT round_key, team || '.row' FROM placed WHERE r NOT BETWEEN 0 AND 3
      UNION SELECT round_key, team || '.col' FROM placed WHERE c NOT BETWEEN 0 AND 6)"""


def checked_stream(spark, d) -> str:
    """Where the checked stream over the raw files wrote."""
    raw = stored_rounds(spark, d)
    stream_checked(spark, raw, f"{raw}-checked", f"{raw}-state", scorer(20.0), dims(), max_files=4).awaitTermination()
    return f"{raw}-checked"


@query(
    "stream_quarantine",
    f"""{NESTED}{BROKEN} SELECT match_uuid, player_uuid, round_name, ts AS timestamp, string_agg(v, ',' ORDER BY v) AS violations
    FROM found JOIN nusable USING (round_key) GROUP BY round_key, match_uuid, player_uuid, round_name, ts""",
)
def stream_quarantine(spark, d):
    kept_apart = read_quarantine(spark, checked_stream(spark, d))
    return kept_apart.select(*ROUND_ID, F.array_join("violations", ",").alias("violations"))


@query(
    "stream_valid_scores",
    f"""{NESTED}{BROKEN}{NENRICHED}, costs AS (SELECT round_key, {SUMS} FROM enriched GROUP BY round_key)
    SELECT match_uuid, player_uuid, round_name, ts AS timestamp, {SCORED.format(p=CHANCE.format(scale=20.0))}
    FROM nusable JOIN costs USING (round_key) WHERE round_key NOT IN (SELECT round_key FROM found)""",
)
def stream_valid_scores(spark, d):
    return rounded(read_scores(spark, checked_stream(spark, d)).select(*ROUND_ID, "win_probability", "prediction"))


# -- metadata ------------------------------------------------------------------------------------------------------------


def metadata(spark, d) -> dict[str, str]:
    """Documents made of ``part``: a set whose sets, champions and traits are lists, and one where they are objects.

    Brands and types are few, so a document is bounded. Fields are missing, of another kind or unknown here and there.
    """
    part = adapter.table(spark, d, "part")
    cost = F.min("p_size").cast("bigint")
    champion = F.struct(
        F.col("p_brand").alias("apiName"),
        F.when(F.col("cost") % 3 > 0, F.concat(F.lit("N"), F.col("cost").cast("string"))).alias("name"),
        F.when(F.col("cost") % 2 == 0, F.col("cost").cast("string")).alias("cost"),
        F.col("traits"),
        F.struct(F.lit(True).alias("odd"), F.array(F.lit(1)).alias("list")).alias("unknown"),
    )
    champions = part.groupBy("p_brand").agg(cost.alias("cost"), F.sort_array(F.collect_set("p_type")).alias("traits")).agg(F.sort_array(F.collect_list(champion)).alias("all"))
    sizes = part.groupBy("p_type").agg(F.sort_array(F.collect_set((F.col("p_size") % 7).cast("bigint"))).alias("sizes"))
    effects = F.transform("sizes", lambda n: F.struct(F.when(n > 0, n).alias("minUnits"), F.lit("x").alias("style")))
    icon = F.when(F.size("sizes") > 2, F.concat(F.lower("p_type"), F.lit(".tex")))
    traits = sizes.agg(F.sort_array(F.collect_list(F.struct(F.col("p_type").alias("name"), icon.alias("icon"), effects.alias("effects")))).alias("every"))
    both = champions.crossJoin(traits)  # one row each
    named = F.create_map(
        F.lit("1"),
        F.struct(
            F.map_from_entries(F.transform("all", lambda c: F.struct(c["apiName"], c))).alias("champions"),
            F.map_from_entries(F.transform("every", lambda t: F.struct(t["name"], t))).alias("traits"),
        ),
    )
    paths = {}
    base = f"{folder(spark)}/metadata-{uuid.uuid4().hex}"
    texts = {
        "list": F.concat(F.lit('{"sets": [{}, '), F.to_json(F.struct(F.col("all").alias("champions"), F.col("every").alias("traits"))), F.lit('], "more": 1}')),
        "object": F.concat(F.lit('{"sets": '), F.to_json(named), F.lit("}")),
    }
    for form, text in texts.items():
        paths[form] = f"{base}/{form}"
        both.select(text.alias("value")).coalesce(1).write.text(paths[form])
    return paths


def sets(spark, d):
    return [(form, sources.read_set(spark, path, 1)) for form, path in metadata(spark, d).items()]


FORMS = "(VALUES ('list'), ('object')) f(form)"


@query(
    "metadata_units",
    f"""SELECT form, p_brand AS unit, CASE WHEN cost % 2 = 0 THEN cost END AS cost, traits
    FROM (SELECT p_brand, cast(min(p_size) AS bigint) AS cost, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS traits FROM part GROUP BY p_brand), {FORMS}""",
)
def metadata_units(spark, d):
    found = [dimensions.dims_from_metadata(s)[0].select(F.lit(form).alias("form"), "unit", "cost", F.array_join("traits", ",").alias("traits")) for form, s in sets(spark, d)]
    return found[0].unionByName(found[1])


@query(
    "metadata_traits",
    f"""SELECT form, trait, coalesce(string_agg(n, ',' ORDER BY n) FILTER (n > 0), '') AS breakpoints
    FROM (SELECT DISTINCT p_type AS trait, p_size % 7 AS n FROM part), {FORMS} GROUP BY form, trait""",
)
def metadata_traits(spark, d):
    found = [dimensions.dims_from_metadata(s)[1].select(F.lit(form).alias("form"), "trait", F.array_join(F.transform("breakpoints", lambda b: b.cast("string")), ",").alias("breakpoints")) for form, s in sets(spark, d)]
    return found[0].unionByName(found[1])


@query(
    "built_dims",
    """SELECT p_brand AS unit, row_number() OVER (ORDER BY p_brand) AS unit_id, CASE WHEN min(p_size) % 2 = 0 THEN cast(min(p_size) AS bigint) END AS cost
    FROM part GROUP BY p_brand""",
)
def built_dims(spark, d):
    """Dimensions out of the metadata, written as JSON files and read back."""
    path = f"{folder(spark)}/dims"
    dimensions.built_dims(sets(spark, d)[1][1]).write(spark, path)
    return dimensions.Dims.read(spark, path).unit_frame(spark).select("unit", "unit_id", "cost")


@query(
    "catalog_job",
    """WITH brands AS (SELECT p_brand, min(p_size) AS cost FROM part GROUP BY p_brand)
    SELECT p_brand AS unit, CASE WHEN cost % 3 > 0 THEN 'N' || cost ELSE p_brand END AS name, CASE WHEN cost % 2 = 0 THEN cast(cost AS bigint) END AS cost
    FROM brands WHERE p_brand <> 'Brand#11'""",
)
def catalog_job(spark, d):
    """Units of the catalog of a set whose dimensions come from the same metadata."""
    chosen = sets(spark, d)[0][1]
    items = spark.createDataFrame([], "apiName string, name string, tags array<string>, icon string")
    tables = build_catalog(spark, dimensions.built_dims(chosen), chosen, items, set_prefix="S", hidden_units=["Brand#11"])
    return tables["units"].select("unit", "name", "cost")


# -- sample boards -------------------------------------------------------------------------------------------------------

SIDE_TEXT = f"""string_agg(concat_ws('/', unit, least(greatest(coalesce(nullif(tier, 0), 1), 1), 4),
      array_to_string(list_slice(list_filter(item_ids, lambda i: i IS NOT NULL AND i <> ''), 1, 3), '+'), {ROW_SQL}, {COL_SQL}), ';' ORDER BY pos)"""
SAMPLED = f"""{NESTED.replace("WITH", "WITH RECURSIVE", 1)}, eligible AS (
      SELECT * FROM rounds WHERE round_type = 'PVP' AND round_outcome IN ('victory', 'defeat')
        AND round_key IN (SELECT round_key FROM sizes GROUP BY round_key HAVING min(coalesce(n, 0)) >= 1)){BAD_UNITS},
    hashed_rows AS (SELECT round_key, match_uuid, split_part(round_name, '-', 1) AS stage, md5(concat(round_key, '|16')) AS k
      FROM eligible WHERE round_key NOT IN (SELECT round_key FROM bad)),
    queue AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY k) AS i FROM hashed_rows),
    walk AS (
      SELECT cast(0 AS bigint) AS i, cast([] AS varchar[]) AS used, cast([] AS varchar[]) AS stages, cast([] AS bigint[]) AS taken
      UNION ALL
      SELECT i, CASE WHEN ok THEN list_append(used, match_uuid) ELSE used END, CASE WHEN ok THEN list_append(stages, stage) ELSE stages END,
        CASE WHEN ok THEN list_append(taken, round_key) ELSE taken END
      FROM (SELECT q.*, used, stages, taken, NOT list_contains(used, match_uuid) AND len(list_filter(stages, lambda s: s = stage)) < 10 AS ok
            FROM walk JOIN queue q ON q.i = walk.i + 1)),
    chosen AS (SELECT unnest(taken) AS round_key FROM (SELECT taken FROM walk ORDER BY i DESC LIMIT 1))
    SELECT round_name AS stage, round_outcome AS outcome, p.text AS player, o.text AS opponent FROM chosen JOIN rounds USING (round_key)
    JOIN (SELECT round_key, {SIDE_TEXT} AS text FROM nunits WHERE team = 'player' GROUP BY round_key) p USING (round_key)
    JOIN (SELECT round_key, {SIDE_TEXT} AS text FROM nunits WHERE team = 'opponent' GROUP BY round_key) o USING (round_key)"""


def boards_as_text(boards):
    def side(board):
        return F.array_join(F.transform(board, lambda u: F.concat_ws("/", u["unit"], u["tier"].cast("string"), F.array_join(u["items"], "+"), u["row"].cast("string"), u["col"].cast("string"))), ";")

    return boards.select("stage", "outcome", side(F.col("player")).alias("player"), side(F.col("opponent")).alias("opponent"))


def sampled(spark, d):
    return sample.sample_boards(adapter.nested_rounds(spark, d), dims(), key="round_key", min_units=1)


@query("sample_boards", SAMPLED)
def sample_boards(spark, d):
    """The sampled boards, each side as text."""
    return boards_as_text(sampled(spark, d))


@query("sample_boards_file", SAMPLED)
def sample_boards_file(spark, d):
    """The same from the file of JSON lines that the job writes."""
    path = f"{folder(spark)}/boards"
    sources.write_sample_boards(sampled(spark, d), path)
    side = "array<struct<unit:string,tier:bigint,items:array<string>,row:int,col:int>>"
    return boards_as_text(spark.read.schema(f"stage string, outcome string, player {side}, opponent {side}").json(path))
