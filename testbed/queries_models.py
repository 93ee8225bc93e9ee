"""Queries on metrics, scores, vocabularies and catalogs, and the model jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from roundhouse import dims as dimensions
from roundhouse.functions import scalars
from roundhouse.operators import catalog, metrics, ordering
from roundhouse.plans import extract, score, train
from roundhouse.session import stored
from testbed import adapter
from testbed.adapter import dims
from testbed.queries_rounds import requests, usable_nested
from testbed.registry import query

# -- metrics over events: a class, a guess and a score per event --------------------------------------------------------

JUDGED = """WITH judged AS (
  SELECT event_id, user_id % 3 AS y, cast(floor(value) AS bigint) % 3 AS guess,
         CASE WHEN event_type IN ('purchase', 'click') THEN 1 ELSE 0 END AS label, value / 500.0 AS score, value / 100.0 - 2.5 AS logit
  FROM events)"""


def judged(spark, d):
    return adapter.table(spark, d, "events").select(
        "event_id",
        (F.col("user_id") % 3).alias("y"),
        (F.floor("value") % 3).alias("guess"),
        F.when(F.col("event_type").isin("purchase", "click"), 1).otherwise(0).alias("label"),
        (F.col("value") / 500.0).alias("score"),
        (F.col("value") / 100.0 - 2.5).alias("logit"),
    )


@query(
    "class_report",
    f"""{JUDGED}, c AS (
      SELECT k, count(*) FILTER (y = k) AS support, count(*) FILTER (guess = k) AS predicted, count(*) FILTER (y = k AND guess = k) AS hit
      FROM judged, (SELECT DISTINCT y AS k FROM judged UNION SELECT DISTINCT guess FROM judged) GROUP BY k),
    r AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE hit / predicted END AS p, CASE WHEN support = 0 THEN 0 ELSE hit / support END AS q,
      CASE WHEN predicted + support = 0 THEN 0 ELSE 2 * hit / (predicted + support) END AS f FROM c)
    SELECT cast(k AS varchar) AS class, round(p, 9) AS precision, round(q, 9) AS recall, round(f, 9) AS f1, support FROM r
    UNION ALL SELECT 'accuracy', round(sum(hit) / sum(support), 9), round(sum(hit) / sum(support), 9), round(sum(hit) / sum(support), 9), cast(sum(support) AS bigint) FROM r
    UNION ALL SELECT 'macro avg', round(avg(p), 9), round(avg(q), 9), round(avg(f), 9), cast(sum(support) AS bigint) FROM r
    UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 9), round(sum(q * support) / sum(support), 9),
      round(sum(f * support) / sum(support), 9), cast(sum(support) AS bigint) FROM r""",
)
def class_report(spark, d):
    report = metrics.class_report(judged(spark, d), "y", "guess")
    return report.select("class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(
    "log_loss",
    f"""{JUDGED} SELECT round(avg(-(label * ln(least(greatest(score, 1e-15), 1 - 1e-15)) + (1 - label) * ln(1 - least(greatest(score, 1e-15), 1 - 1e-15)))), 8) AS log_loss FROM judged""",
)
def log_loss(spark, d):
    return metrics.log_loss(judged(spark, d), "label", "score").select(F.round("log_loss", 8).alias("log_loss"))


@query(
    "log_loss_logit",
    f"{JUDGED} SELECT round(avg(-(label * ln(1 / (1 + exp(-logit))) + (1 - label) * ln(1 - 1 / (1 + exp(-logit))))), 8) AS log_loss FROM judged",
)
def log_loss_logit(spark, d):
    return metrics.log_loss(judged(spark, d), "label", "logit", from_logit=True).select(F.round("log_loss", 8).alias("log_loss"))


@query("brier", f"{JUDGED} SELECT round(avg((score - label) ** 2), 8) AS brier FROM judged")
def brier(spark, d):
    return metrics.brier(judged(spark, d), "label", "score").select(F.round("brier", 8).alias("brier"))


@query(
    "roc_auc",
    f"""{JUDGED}, g AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM judged GROUP BY score),
    w AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
    SELECT round(sum(pos * (before + neg / 2)) / (sum(pos) * sum(neg)), 9) AS roc_auc FROM w""",
)
def roc_auc(spark, d):
    return metrics.roc_auc(judged(spark, d), "label", "score").select(F.round("roc_auc", 9).alias("roc_auc"))


@query("sigmoid", f"{JUDGED} SELECT event_id, round(1 / (1 + exp(-logit)), 9) AS probability FROM judged")
def sigmoid(spark, d):
    return metrics.with_probability(judged(spark, d), "logit").select("event_id", F.round("probability", 9).alias("probability"))


@query("decision", f"{JUDGED} SELECT event_id, CASE WHEN score >= 0.5 THEN 'victory' ELSE 'defeat' END AS verdict FROM judged")
def decision(spark, d):
    return judged(spark, d).select("event_id", scalars.decision(F.col("score")).alias("verdict"))


@query("best_trial", "SELECT o_orderkey AS trial, o_totalprice AS loss, o_orderpriority AS params FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1")
def best_trial(spark, d):
    trials = adapter.table(spark, d, "orders").selectExpr("o_orderkey AS trial", "o_totalprice AS loss", "o_orderpriority AS params")
    return metrics.best_trial(trials)


# -- vocabularies and catalogs over parts -------------------------------------------------------------------------------


@query(
    "build_vocab",
    """SELECT key, row_number() OVER (ORDER BY first, key) AS id FROM (SELECT p_brand AS key, min(p_partkey) AS first FROM part GROUP BY p_brand)""",
)
def build_vocab(spark, d):
    return dimensions.vocab_of(adapter.table(spark, d, "part"), "p_brand", "p_partkey")


PAIRS = """SELECT DISTINCT p_brand AS trait, p_size % 7 AS breakpoint FROM part"""


@query("build_trait_vocab", f"SELECT trait, breakpoint, row_number() OVER (ORDER BY trait, breakpoint) AS id FROM ({PAIRS})")
def build_trait_vocab(spark, d):
    pairs = adapter.table(spark, d, "part").select(F.col("p_brand").alias("trait"), (F.col("p_size") % 7).alias("breakpoint")).distinct()
    return ordering.global_rank(pairs, ["trait", "breakpoint"], "_rank").select("trait", "breakpoint", (F.col("_rank") + 1).alias("id"))


@query(
    "vocab_parse",
    """SELECT p_partkey, split_part(k, '_', 1) AS name, cast(split_part(k, '_', -1) AS bigint) AS breakpoint
    FROM (SELECT p_partkey, concat(p_brand, '_', p_size) AS k FROM part)""",
)
def vocab_parse(spark, d):
    key = F.concat("p_brand", F.lit("_"), F.col("p_size").cast("string"))
    name, number = scalars.vocab_key_parts(key)
    return adapter.table(spark, d, "part").select("p_partkey", name.alias("name"), number.alias("breakpoint"))


ITEM_NAMES = """SELECT p_partkey, p_name, p_size, CASE p_partkey % 6 WHEN 0 THEN 'S1_Item_Bilgewater_' WHEN 1 THEN 'S1_Artifact_' ELSE 'S1_Item_' END
  || p_brand || CASE WHEN p_partkey % 5 = 0 THEN 'Radiant' ELSE '' END AS item,
  CASE WHEN p_size % 9 = 0 THEN ['component'] WHEN p_size % 9 = 1 THEN ['x', '{44ace175}'] WHEN p_size % 9 = 2 THEN ['{6ef5c598}'] END AS tags,
  p_size % 8 = 0 AS emblem FROM part"""
CATEGORY_SQL = """CASE WHEN emblem THEN 'emblem' WHEN coalesce(list_contains(tags, 'component'), false) THEN 'component'
  WHEN starts_with(item, 'S1_Item_Bilgewater_') THEN 'bilgewater'
  WHEN coalesce(list_contains(tags, '{6ef5c598}'), false) OR item LIKE '%Radiant' THEN 'radiant'
  WHEN coalesce(list_contains(tags, '{44ace175}'), false) OR contains(item, '_Artifact_') THEN 'artifact' ELSE 'normal' END"""


def item_names(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    prefix = F.when(k % 6 == 0, "S1_Item_Bilgewater_").when(k % 6 == 1, "S1_Artifact_").otherwise("S1_Item_")
    tags = (
        F.when(size % 9 == 0, F.array(F.lit("component")))
        .when(size % 9 == 1, F.array(F.lit("x"), F.lit(scalars.ARTIFACT_TAG)))
        .when(size % 9 == 2, F.array(F.lit(scalars.RADIANT_TAG)))
    )
    return adapter.table(spark, d, "part").select(
        "p_partkey",
        "p_name",
        "p_size",
        F.concat(prefix, "p_brand", F.when(k % 5 == 0, "Radiant").otherwise("")).alias("item"),
        tags.alias("tags"),
        (size % 8 == 0).alias("emblem"),
    )


@query("categorize", f"SELECT p_partkey, {CATEGORY_SQL} AS category FROM ({ITEM_NAMES})")
def categorize(spark, d):
    category = scalars.item_category(F.col("item"), F.col("tags"), F.col("emblem"), "S1")
    return item_names(spark, d).select("p_partkey", category.alias("category"))


@query(
    "categorize_by_name",
    f"""SELECT p_partkey, CASE WHEN emblem THEN 'emblem' WHEN regexp_matches(item, '(?i)Artifact|Ornn|Shimmerscale|TheDarkin') THEN 'artifact'
    WHEN regexp_matches(item, '(?i)Radiant$') THEN 'radiant' WHEN regexp_matches(item, '(?i)Bilgewater_') THEN 'bilgewater' ELSE 'normal' END AS category
    FROM ({ITEM_NAMES})""",
)
def categorize_by_name(spark, d):
    category = scalars.item_category_fallback(F.col("item"), F.col("emblem"))
    return item_names(spark, d).select("p_partkey", category.alias("category"))


@query(
    "sanitize_name",
    """SELECT p_partkey, replace(replace(p_name || '''s Part', ' ', '_'), '''', '') AS safe,
    replace(replace(lower(p_type || '/' || p_name || CASE WHEN p_size % 2 = 0 THEN '.TEX' ELSE '.dds' END), '.tex', '.png'), '.dds', '.png') AS icon FROM part""",
)
def sanitize_name(spark, d):
    path = F.concat("p_type", F.lit("/"), "p_name", F.when(F.col("p_size") % 2 == 0, ".TEX").otherwise(".dds"))
    return adapter.table(spark, d, "part").select(
        "p_partkey", scalars.safe_name(F.concat("p_name", F.lit("'s Part"))).alias("safe"), scalars.icon_path(path).alias("icon")
    )


@query(
    "catalog_units",
    """SELECT unit, CASE WHEN m.u IS NOT NULL THEN m.name ELSE unit END AS name, CASE WHEN m.u IS NOT NULL THEN m.cost ELSE v.cost END AS cost,
    CASE WHEN m.u IS NOT NULL THEN 1 ELSE 0 END AS has_icon, CASE WHEN unit IN ('Brand#2', 'Brand#3') THEN 1 ELSE 0 END AS special
    FROM (SELECT p_brand AS unit, cast(min(p_size) AS bigint) AS cost FROM part GROUP BY 1) v
    LEFT JOIN (SELECT p_brand AS u, min(p_name) AS name, cast(CASE WHEN min(p_partkey) % 2 = 0 THEN max(p_size) END AS bigint) AS cost
      FROM part WHERE p_partkey % 40 < 20 AND p_brand NOT IN ('Brand#5', 'Brand#6') GROUP BY 1) m ON m.u = v.unit
    WHERE unit NOT IN ('Brand#1')""",
)
def catalog_units(spark, d):
    part = adapter.table(spark, d, "part")
    units = part.groupBy(F.col("p_brand").alias("unit")).agg(F.min("p_size").cast("bigint").alias("cost"))
    units = units.withColumn("traits", F.lit(None).cast("array<string>"))
    described = part.filter((F.col("p_partkey") % 40 < 20) & ~F.col("p_brand").isin("Brand#5", "Brand#6"))
    meta = described.groupBy(F.col("p_brand").alias("unit")).agg(
        F.min("p_name").alias("name"),
        F.when(F.min("p_partkey") % 2 == 0, F.max("p_size")).cast("bigint").alias("cost"),
        F.lit(None).cast("array<string>").alias("traits"),
    )
    shown = catalog.catalog_units(units, meta, hidden=["Brand#1"], special=["Brand#2", "Brand#3"])
    return shown.select("unit", "name", "cost", F.col("has_icon").cast("int").alias("has_icon"), F.col("special").cast("int").alias("special"))


@query(
    "catalog_items",
    f"""SELECT i.item, coalesce(nullif(name, ''), i.item) AS name, {CATEGORY_SQL.replace('item', 'i.item')} AS category,
    CASE WHEN emblem THEN 1 ELSE 0 END AS is_emblem, e.emblem_trait, CASE WHEN coalesce(icon, '') <> '' THEN 1 ELSE 0 END AS has_icon
    FROM (SELECT DISTINCT item FROM ({ITEM_NAMES})) i
    LEFT JOIN (SELECT item, max(p_name) AS name, max(tags) AS tags, CASE WHEN max(p_size) > 40 THEN 'y' ELSE '' END AS icon FROM ({ITEM_NAMES}) GROUP BY item) m ON m.item = i.item
    LEFT JOIN (SELECT item, 'T' || min(p_size) AS emblem_trait, true AS emblem FROM ({ITEM_NAMES}) WHERE emblem GROUP BY item) e ON e.item = i.item
    WHERE i.item <> 'S1_Item_Brand#1'""",
)
def catalog_items(spark, d):
    names = item_names(spark, d)
    items = names.select("item").distinct()
    meta = names.groupBy("item").agg(
        F.max("p_name").alias("name"), F.max("tags").alias("tags"), F.when(F.max("p_size") > 40, "y").otherwise("").alias("icon")
    )
    emblems = names.filter("emblem").groupBy("item").agg(F.concat(F.lit("T"), F.min("p_size").cast("string")).alias("trait"))
    shown = catalog.catalog_items(items, emblems, meta, set_prefix="S1", hidden=["S1_Item_Brand#1"])
    return shown.select(
        "item", "name", "category", F.col("is_emblem").cast("int").alias("is_emblem"), "emblem_trait", F.col("has_icon").cast("int").alias("has_icon")
    )


@query(
    "catalog_traits",
    """SELECT trait, array_to_string(list_sort(points), ',') AS breakpoints, CASE WHEN len(points) = 1 THEN 1 ELSE 0 END AS single,
    replace(trait, ' ', '_') AS icon_name, CASE WHEN m.p_name IS NOT NULL THEN 1 ELSE 0 END AS has_icon
    FROM (SELECT p_name AS trait, list(DISTINCT p_size % 3) AS points FROM part GROUP BY 1)
    LEFT JOIN (SELECT DISTINCT p_name FROM part WHERE p_type = 'PROMO') m ON m.p_name = trait""",
)
def catalog_traits(spark, d):
    part = adapter.table(spark, d, "part")
    # a set of remainders of 3 holds at most three values
    traits = part.groupBy(F.col("p_name").alias("trait")).agg(F.collect_set(F.col("p_size") % 3).alias("breakpoints"))
    meta = part.filter("p_type = 'PROMO'").select(F.col("p_name").alias("trait"), F.lit("y").alias("icon")).distinct()
    shown = catalog.catalog_traits(traits, meta)
    return shown.select(
        "trait", F.array_join("breakpoints", ",").alias("breakpoints"), F.col("unique").cast("int").alias("single"), "icon_name", F.col("has_icon").cast("int").alias("has_icon")
    )


@query(
    "catalog_order",
    """SELECT p_partkey, row_number() OVER (ORDER BY p_type = 'PROMO', coalesce(nullif(p_size % 6, 0), 99), p_name, p_partkey) - 1 AS place FROM part""",
)
def catalog_order(spark, d):
    part = adapter.table(spark, d, "part").select(
        "p_partkey", (F.col("p_type") == "PROMO").alias("special"), (F.col("p_size") % 6).alias("cost"), F.col("p_name").alias("name")
    )
    return ordering.global_rank(part, [*catalog.unit_order(), F.col("p_partkey")], "place").select("p_partkey", "place")


@query(
    "item_order",
    f"""SELECT p_partkey, row_number() OVER (ORDER BY list_position(['normal', 'component', 'emblem', 'artifact', 'bilgewater', 'radiant'], category), item, p_partkey) - 1 AS place
    FROM (SELECT p_partkey, item, {CATEGORY_SQL} AS category FROM ({ITEM_NAMES}))""",
)
def item_order(spark, d):
    category = scalars.item_category(F.col("item"), F.col("tags"), F.col("emblem"), "S1")
    rows = item_names(spark, d).select("p_partkey", F.col("item").alias("name"), category.alias("category"))
    return ordering.global_rank(rows, [*catalog.item_order(), F.col("p_partkey")], "place").select("p_partkey", "place")


# -- models: rows depend on the fitted parameters, so they have no SQL ---------------------------------------------------


# training writes the rows that it reads several times


def wide_training(spark, d):
    prepared = usable_nested(spark, d).withColumn("round_idx", F.col("round_key").cast("string"))
    return extract.wide_rows(prepared, dims())


def board_training(spark, d):
    prepared = usable_nested(spark, d).withColumn("round_idx", F.col("round_key").cast("string"))
    return stored(extract.trait_id_rows(prepared, dims()))


def tabular(spark, d) -> train.Trained:
    return train.train_tabular(wide_training(spark, d), dims().wide_names)


def board(spark, d) -> train.Trained:
    return train.train_board(board_training(spark, d), trait_ids=True)


@query("train_tabular")
def train_tabular(spark, d):
    return tabular(spark, d).metrics


@query("top_importances")
def top_importances(spark, d):
    return train.top_importances(tabular(spark, d))


@query("train_board")
def train_board(spark, d):
    return board(spark, d).metrics


@query("score_boards")
def score_boards(spark, d):
    tree, logistic = tabular(spark, d), board(spark, d)
    models = {"vit": score.Scorer(logistic.model, "vit"), "xgboost": score.Scorer(tree.model, "xgboost", tuple(tree.features))}
    return score.score_requests(requests(spark, d), models, dims())[0]


@query("search_board")
def search_board(spark, d):
    space = {"regParam": train.Uniform(1e-3, 1e-1, log=True), "width": train.Choice((1 << 10, 1 << 12)), "augment": train.Uniform(0.0, 0.5, step=0.25)}
    return train.search_board(board_training(spark, d), space, n_trials=3, seed=3)[0]
