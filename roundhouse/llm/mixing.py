"""Mix sources to target weights by hierarchical budgets.

Leaves are (domain, language, source) cells of the corpus; a tree over them carries weights. The token budget flows from the root: each
child gets its share by weight, but never more than its subtree can give (its tokens times the allowed epochs). What a leaf can't take
goes to its siblings first, and reaches the siblings of an ancestor only when the whole subtree is spent.

A leaf with ``a`` tokens to give takes whole epochs while they fit, then a prefix of a last epoch in which documents stand in the order
of a seeded hash. The prefix is cut exactly: token sums of hash ranges find the range in which the leaf's budget ends, and only that
range's rows are put in order. So a leaf that holds most of the corpus is neither sorted nor gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roundhouse.llm.shared import Scratch, fresh

Leaf = tuple[str, str, str]
#: hash ranges of a leaf; the rows put in order are one range of each leaf
RANGE_BITS = 14
MAX_LEAVES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def share_out(budget: int, children: list[tuple[float, int]]) -> list[int]:
    """Whole tokens for each (weight, capacity), together ``budget`` as far as the weighted capacities go.

    Shares are by weight; a full child's shortage is shared again among the others. Rounding is by largest remainder, first child first.
    """
    given = [0] * len(children)
    open_ = [k for k, (w, c) in enumerate(children) if w > 0 and c > 0]
    left = min(budget, sum(children[k][1] for k in open_))
    while open_ and left > 0:
        total = sum(children[k][0] for k in open_)
        full = [k for k in open_ if left * children[k][0] / total >= children[k][1]]
        if full:
            for k in full:
                given[k] = children[k][1]
            left -= sum(given[k] for k in full)
            open_ = [k for k in open_ if k not in full]
            continue
        exact = {k: left * children[k][0] / total for k in open_}
        for k in open_:
            given[k] = int(exact[k])
        rest = left - sum(given[k] for k in open_)
        for k in sorted(open_, key=lambda k: (int(exact[k]) - exact[k], k)):
            if rest <= 0:
                break
            more = min(1, children[k][1] - given[k])
            given[k] += more
            rest -= more
        left = 0
    return given


def budgets(capacity: Mapping[Leaf, int], weight: Callable[[tuple[str, ...]], float], budget: int) -> dict[Leaf, int]:
    """Tokens for each leaf. ``weight`` is asked for each path of the tree: ``(domain,)``, ``(domain, lang)``, ``(domain, lang, source)``."""
    out: dict[Leaf, int] = {}

    def spread(prefix: tuple[str, ...], leaves: list[Leaf], tokens: int) -> None:
        depth = len(prefix)
        if depth == 3:
            out[leaves[0]] = tokens
            return
        names = sorted({leaf[depth] for leaf in leaves})
        below = {n: [leaf for leaf in leaves if leaf[depth] == n] for n in names}
        usable = {n: sum(reach(leaf, depth + 1) for leaf in below[n]) for n in names}
        for n, given in zip(names, share_out(tokens, [(weight((*prefix, n)), usable[n]) for n in names])):
            spread((*prefix, n), below[n], given)

    def reach(leaf: Leaf, depth: int) -> int:
        """The leaf's capacity, or 0 if a weight of 0 shuts it off below this depth."""
        return capacity[leaf] if all(weight(leaf[: d + 1]) > 0 for d in range(depth, 3)) else 0

    spread((), sorted(capacity), budget)
    return out


def tokens_of(text: Column) -> Column:
    """Words of a text, the measure of budgets where no token count is given; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def mix(
    docs: DataFrame,
    domain: Column,
    weight: Callable[[tuple[str, ...]], float],
    share: float,
    max_epochs: int = 1,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """All columns of every row, and ``copies``: how often the mixture takes it (0: not at all).

    The budget is ``share`` of the corpus's tokens. ``max_epochs`` bounds how often a leaf may be repeated. A document is taken if the
    tokens before it in its leaf's order are fewer than the leaf's budget, so a leaf overshoots by less than one document. Null domain,
    language or source counts as ''. Documents without tokens add nothing and are taken with what stands around them. Ties of the hash
    go by the id, then the text's hash; rows alike in all of these are ordered as they come. The name ``copies`` is made unique if taken.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    d, lang, source, n, h, r = fresh(docs.columns, "domain_", "lang_", "source_", "tokens_", "hash_", "range_")
    leaf = [d, lang, source]
    cells = {d: F.coalesce(domain, F.lit("")), lang: F.coalesce(F.col(lang_col), F.lit("")), source: F.coalesce(F.col(source_col), F.lit(""))}
    marked = docs.withColumns(cells | {h: F.xxhash64(F.lit(seed), F.col(id_col))})
    marked = marked.withColumn(r, F.shiftrightunsigned(h, 64 - RANGE_BITS).cast("int"))
    sums = scratch.save(marked.groupBy(*leaf, r).agg(F.sum(tokens_of(F.col(text_col))).alias("tokens")))
    cells_found = sums.groupBy(*leaf).agg(F.sum("tokens").alias("tokens")).limit(MAX_LEAVES + 1).collect()
    if len(cells_found) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves: a source name for each document is no mixture")
    held = {(x[0], x[1], x[2]): int(x[3]) for x in cells_found}
    given = budgets({k: v * max_epochs for k, v in held.items()}, weight, round(share * sum(held.values())))
    plan = spark.createDataFrame([(*k, a // max(1, held[k]), a - a // max(1, held[k]) * held[k]) for k, a in given.items()], f"{d} string, {lang} string, {source} string, whole bigint, rest bigint")
    before = F.sum("tokens").over(Window.partitionBy(*leaf).orderBy(r).rowsBetween(Window.unboundedPreceding, -1))
    ranges = sums.withColumn("before", F.coalesce(before, F.lit(0))).join(F.broadcast(plan), leaf)
    # the range in which the leaf's last epoch ends: one row for each leaf, so at most MAX_LEAVES
    ends = ranges.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("tokens") >= F.col("rest")))
    cut = plan.join(ends.select(*leaf, F.col(r).alias("cut"), "before"), leaf, "left")
    whole, rest, at, base, copies = fresh([*marked.columns], "whole_", "rest_", "cut_", "before_", "copies")
    cut = scratch.save(cut.select(*leaf, F.col("whole").alias(whole), F.col("rest").alias(rest), F.coalesce("cut", F.lit(-1)).alias(at), F.coalesce("before", F.lit(0)).alias(base)))
    joined = marked.join(F.broadcast(cut), leaf)
    outside = joined.where(F.col(r) != F.col(at)).withColumn(copies, F.col(whole) + F.when(F.col(r) < F.col(at), 1).otherwise(0))
    order = Window.partitionBy(*leaf).orderBy(h, id_col, F.xxhash64(text_col)).rowsBetween(Window.unboundedPreceding, -1)
    inside = joined.where(F.col(r) == F.col(at)).withColumn(n, tokens_of(F.col(text_col))).withColumn(copies, F.coalesce(F.sum(n).over(order), F.lit(0)) + F.col(base))
    inside = inside.withColumn(copies, F.col(whole) + F.when(F.col(copies) < F.col(rest), 1).otherwise(0))
    columns = [*docs.columns, copies]
    return outside.select(columns).unionByName(inside.select(columns)).withColumn(copies, F.col(copies).cast("bigint"))
