"""Mixing sources to target weights: hierarchical token budgets over a tree such as domain, language, source.

The budget flows down the tree. At each node it is shared among the children by weight, no child getting more than its
subtree can give (its tokens times max_epochs); what a child cannot take goes to its siblings by their weights first, and
only what a whole subtree cannot take shows one level up, where it is shared among that subtree's siblings. All amounts
are whole tokens, rounded down. A leaf with budget q and t tokens takes every document q div t times, and of one more
epoch the prefix, in an order seeded by leaf epoch and document id, whose tokens sum to at most q mod t.

DataFrame operations only. The prefix is found without gathering a leaf: sums by the first two hex digits of the
order key, then by four within the one range where the budget ends, then by six, then over the few documents left.

Edge cases: a null text has no tokens; null levels are a branch of their own; documents without tokens are taken where
the order reaches them; rows with one id (null ids too) are taken or left together, as are repeated rows; weights of zero
and an empty table give no rows; other columns pass unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viatica.llm.base import cut, table

WORDS = r"[^\x20\x09-\x0D]+"
#: A tree of at most so many leaves is broadcast; a larger one is joined by shuffling.
BROADCAST_LEAVES = 50_000
BIG = "decimal(38,0)"

DOMAIN = "coalesce('domain' || try_cast(substr(source, 4) as int) % 4, 'none')"
LEVELS = {"domain": DOMAIN, "lang": "coalesce(lang, 'none')", "source": "coalesce(source, 'none')"}
WEIGHTS = {"domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}


def tokens(text: str = "text") -> Column:
    """Words of a text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    out = F.lit(1)
    for value, weight in weights.get(level, {}).items():
        out = F.when(F.col(level) == value, F.lit(int(weight))).otherwise(out)
    return out.cast(BIG)


def leaf_quotas(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], share: tuple[int, int], max_epochs: int) -> DataFrame:
    """leaves (levels..., tokens) with the column quota; share is the budget as a fraction of all tokens."""
    whole = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast(BIG).alias("all"))
    numerator, denominator = (F.lit(x).cast(BIG) for x in share)
    budget = F.expr("all * n div d").cast(BIG)
    above = whole.withColumns({"n": numerator, "d": denominator}).select(F.least(budget, (F.col("all") * max_epochs).cast(BIG)).alias("quota"))
    for depth in range(1, len(levels) + 1):
        own, parent = list(levels[:depth]), list(levels[: depth - 1])
        nodes = leaves.groupBy(*own).agg((F.sum("tokens") * max_epochs).cast(BIG).alias("cap")).withColumn("w", _weight(levels[depth - 1], weights))
        nodes = nodes.join(above.withColumnRenamed("quota", "b"), parent) if parent else nodes.crossJoin(above.withColumnRenamed("quota", "b"))  # one row
        order = Window.partitionBy(*(parent or [F.lit(0)])).orderBy(F.col("w") == 0, F.expr("cast(cap as double) / nullif(cast(w as double), 0)"), levels[depth - 1])
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        nodes = nodes.withColumns({"taken": F.coalesce(F.sum("cap").over(before), F.lit(0)).cast(BIG), "rest": F.sum("w").over(after).cast(BIG)})
        nodes = nodes.withColumn("full", F.expr("w > 0 and cap * rest <= (b - taken) * w"))
        all_ = Window.partitionBy(*(parent or [F.lit(0)]))
        nodes = nodes.withColumns({"given": F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(all_), F.lit(0)).cast(BIG), "left": F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))).over(all_), F.lit(0)).cast(BIG)})
        above = nodes.select(*own, F.expr("case when full then cap when w = 0 or left = 0 then 0 else cast((b - given) * w div left as decimal(38,0)) end").cast(BIG).alias("quota"))
    return leaves.join(above, list(levels))


def _at_leaves(rows: DataFrame, leaves: DataFrame, on: list[str], small: bool) -> DataFrame:
    return rows.join(F.broadcast(leaves) if small else leaves, on)


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def plan(docs: DataFrame, levels: Mapping[str, str], weights: Mapping[str, Mapping[str, int]], share: tuple[int, int], max_epochs: int, seed: int) -> tuple[DataFrame, DataFrame, bool]:
    """Slim rows (levels, doc_id, n_tokens), the leaves with epochs and the order key at which the last epoch ends, and whether the leaves are few."""
    names = list(levels)
    slim = cut(docs.select(*[F.expr(e).alias(n) for n, e in levels.items()], F.col("doc_id"), tokens().alias("n_tokens")))
    leaves = cut(leaf_quotas(slim.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")), names, weights, share, max_epochs))
    small = leaves.count() <= BROADCAST_LEAVES
    leaves = leaves.withColumns({"epochs": F.expr("case when tokens > 0 then cast(quota div tokens as bigint) else cast(0 as bigint) end")})
    leaves = leaves.withColumn("part", F.expr("cast(quota - epochs * tokens as bigint)"))
    rows = _at_leaves(slim, leaves, names, small).withColumn("k", order_key(seed, F.col("epochs"), F.col("doc_id")))
    found = leaves.select(*names, F.lit("").alias("at"), F.lit(0).cast("long").alias("before"), "part")
    for digits in (2, 4, 6, 32):
        inside = _at_leaves(rows.drop("part"), found, names, small).filter(F.col("k").startswith(F.col("at")))
        sums = inside.groupBy(*names, F.substring("k", 1, digits).alias("at")).agg(F.sum("n_tokens").alias("n"), F.first("before").alias("before"), F.first("part").alias("part"))
        order = Window.partitionBy(*names).orderBy("at")
        sums = sums.withColumn("upto", F.col("before") + F.sum("n").over(order)).filter("upto > part")
        first = sums.groupBy(*names).agg(F.min(F.struct("at", (F.col("upto") - F.col("n")).alias("before"), "part")).alias("x"))
        found = cut(first.select(*names, "x.at", "x.before", "x.part"))
    # no such range: every document of the epoch fits
    ends = leaves.join(found.select(*names, F.col("at").alias("end")), names, "left").withColumn("end", F.coalesce("end", F.lit("~")))
    return slim, cut(ends), small


def copies(seed: int, doc_id: Column) -> Column:
    return (F.col("epochs") + (order_key(seed, F.col("epochs"), doc_id) < F.col("end")).cast("long")).cast("long")


def mix(docs: DataFrame, levels: Mapping[str, str] = LEVELS, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, share: tuple[int, int] = (6, 10), max_epochs: int = 1, seed: int = 7) -> DataFrame:
    """Rows of docs that are taken at least once, with their columns alone; with max_epochs 1, at most once."""
    _, ends, small = plan(docs, levels, weights, share, max_epochs, seed)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d")
    keyed = docs.select(row, *[F.expr(e).alias(f"level_{n}") for n, e in levels.items()])
    ends = ends.select(*[F.col(n).alias(f"level_{n}") for n in levels], "epochs", "end")
    taken = _at_leaves(keyed, ends, [f"level_{n}" for n in levels], small).withColumn("copies", copies(seed, F.col("d.doc_id"))).filter("copies > 0")
    taken = taken if max_epochs == 1 else taken.select("d", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select(*[F.col(f"d.`{c}`").alias(c) for c in docs.columns])


def mixture(docs: DataFrame, levels: Mapping[str, str] = LEVELS, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, share: tuple[int, int] = (6, 10), max_epochs: int = 2, seed: int = 7) -> DataFrame:
    """(levels, doc_id, n_tokens, copies) of every document taken, without its text."""
    slim, ends, small = plan(docs, levels, weights, share, max_epochs, seed)
    rows = _at_leaves(slim, ends.select(*levels, "epochs", "end"), list(levels), small).withColumn("copies", copies(seed, F.col("doc_id")))
    return rows.filter("copies > 0").select("doc_id", *levels, "n_tokens", "copies")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


def _level_sql(depth: int) -> str:
    own, parent = ", ".join(list(LEVELS)[:depth]), ", ".join(list(LEVELS)[: depth - 1])
    level = list(LEVELS)[depth - 1]
    weight = "CASE " + " ".join(f"WHEN {level} = '{v}' THEN {w}" for v, w in WEIGHTS[level].items()) + " ELSE 1 END" if level in WEIGHTS else "1"
    by = f"PARTITION BY {parent} " if parent else ""
    source = f"n{depth - 1} JOIN (SELECT {own}, sum(tokens) * 2 AS cap FROM leaves GROUP BY {own}) USING ({parent})" if parent else f"(SELECT {own}, sum(tokens) * 2 AS cap FROM leaves GROUP BY {own}), (SELECT least(sum(tokens) * 6 // 10, sum(tokens) * 2) AS quota FROM leaves)"
    return f"""a{depth} AS (SELECT {own}, quota AS b, cap, CAST({weight} AS HUGEINT) AS w FROM {source}),
b{depth} AS (SELECT *, coalesce(sum(cap) OVER ({by}ORDER BY CAST(cap AS DOUBLE) / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
  sum(w) OVER ({by}ORDER BY CAST(cap AS DOUBLE) / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM a{depth}),
c{depth} AS (SELECT *, cap * rest <= (b - taken) * w AS sated FROM b{depth}),
d{depth} AS (SELECT *, coalesce(sum(cap) FILTER (WHERE sated) OVER ({by}), 0) AS given, coalesce(sum(w) FILTER (WHERE NOT sated) OVER ({by}), 0) AS wanting FROM c{depth}),
n{depth} AS (SELECT {own}, CASE WHEN sated THEN cap WHEN wanting = 0 THEN 0 ELSE (b - given) * w // wanting END AS quota FROM d{depth})"""


SQL = f"""
WITH slim AS (
  SELECT doc_id, coalesce('domain' || CAST(TRY_CAST(substr(source, 4) AS INTEGER) % 4 AS VARCHAR), 'none') AS domain, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM slim GROUP BY ALL),
{_level_sql(1)},
{_level_sql(2)},
{_level_sql(3)},
q AS (SELECT domain, lang, source, tokens, quota, CASE WHEN tokens > 0 THEN CAST(quota // tokens AS BIGINT) ELSE 0 END AS epochs FROM leaves JOIN n3 USING (domain, lang, source)),
r AS (SELECT slim.*, epochs, quota - epochs * tokens AS part, md5('7:' || CAST(epochs AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)) AS k FROM slim JOIN q USING (domain, lang, source)),
s AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k) <= part AS extra FROM r)
SELECT doc_id, domain, lang, source, n_tokens, CAST(epochs + CASE WHEN extra THEN 1 ELSE 0 END AS BIGINT) AS copies FROM s WHERE epochs > 0 OR extra
"""
