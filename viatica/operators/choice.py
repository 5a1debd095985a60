"""Discrete choice: utilities, logit and nested logit, draws, apportionment, route overlap, gaps and step rules."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Coefficients of the built-in logit, per minute, euro and transfer.
BETAS = {"time_min": -0.2, "cost_eur": -1.2, "transfers": -1.0}


def utility(betas: Mapping[str, float] = BETAS) -> Column:
    """Linear utility; a name a*b is the product of two attributes."""
    out = F.lit(0.0)
    for name, beta in betas.items():
        term = F.lit(1.0)
        for part in name.split("*"):
            term = term * F.col(part)
        out = out + F.lit(float(beta)) * term
    return out


def class_utility(alternatives: DataFrame, class_betas: DataFrame, betas: Mapping[str, float] = BETAS) -> DataFrame:
    """Adds u, each class with its own coefficients where class_betas (class, attribute, beta) names some."""
    names = list(betas)
    wide = class_betas.groupBy("class").pivot("attribute", names).agg(F.first("beta"))
    wide = wide.select("class", *[F.col(f"`{n}`").alias(f"beta_{i}") for i, n in enumerate(names)])
    u = F.lit(0.0)
    for i, n in enumerate(names):
        u = u + F.coalesce(F.col(f"beta_{i}"), F.lit(float(betas[n]))) * F.col(n)
    return alternatives.join(wide, "class", "left").withColumn("u", u).drop(*[f"beta_{i}" for i in range(len(names))])


def situation() -> Window:
    return Window.partitionBy("situation")


def logit(rows: DataFrame, u: str = "u") -> DataFrame:
    """Adds p, shifted by the situation's greatest utility so that no exponential overflows."""
    shifted = F.exp(F.col(u) - F.max(u).over(situation()))
    return rows.withColumn("e", shifted).withColumn("p", F.col("e") / F.sum("e").over(situation())).drop("e")


def logsums(rows: DataFrame, u: str = "u") -> DataFrame:
    top = rows.withColumn("top", F.max(u).over(situation()))
    return top.groupBy("situation").agg((F.max("top") + F.log(F.sum(F.exp(F.col(u) - F.col("top"))))).alias("logsum"))


def nested_logit(rows: DataFrame, mu: float = 0.5) -> DataFrame:
    """Adds p: within nests with scale 1 / mu, between nests by mu times their logsums."""
    nest = Window.partitionBy("situation", "nest")
    rows = rows.withColumn("top", F.max("u").over(nest))
    rows = rows.withColumn("e", F.exp((F.col("u") - F.col("top")) / mu)).withColumn("inner", F.sum("e").over(nest))
    rows = rows.withColumn("v", F.col("top") + mu * F.log("inner"))
    best = F.max("v").over(situation())
    share = F.exp(F.col("v") - best)
    rows = rows.withColumn("w", share)
    # each nest counts once: its weight is spread over its alternatives by their inner share
    rows = rows.withColumn("x", F.col("w") * F.col("e") / F.col("inner"))
    return rows.withColumn("p", F.col("x") / F.sum("x").over(situation())).drop("top", "e", "inner", "v", "w", "x")


def first_best(rows: DataFrame, by: Column, position: str = "alternative") -> DataFrame:
    """The row with the greatest value in each situation, the first of a tie."""
    n = F.row_number().over(situation().orderBy(by.desc(), position))
    return rows.withColumn("n", n).filter("n = 1").drop("n")


def uniform(seed: int, *keys: str) -> Column:
    """A draw in (0, 1) addressed by keys: the first 13 hexadecimal digits of an md5."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def gumbel(u: Column) -> Column:
    return -F.log(-F.log(u))


def quota_pick(rows: DataFrame, turn: Column) -> DataFrame:
    """The alternative in which `turn` (0 to 1) falls on the situation's cumulative probabilities; the last one if rounding leaves a rest."""
    order = situation().orderBy("alternative")
    c = rows.withColumn("c", F.round(F.sum("p").over(order), 9)).withColumn("turn_", turn)
    last = F.max("alternative").over(situation())
    hit = c.withColumn("last", last).filter((F.col("c") > F.col("turn_")) | (F.col("alternative") == F.col("last")))
    return hit.groupBy("situation").agg(F.min("alternative").alias("alternative"))


def apportion(rows: DataFrame, key: list[str], share: Column, total: Column, order: list[str]) -> DataFrame:
    """Largest remainders: whole numbers that sum to total in each key and follow the shares (which sum to `of`)."""
    w = Window.partitionBy(*key)
    rows = rows.withColumn("exact_num", share * total).withColumn("of", F.sum(share).over(w))
    rows = rows.withColumn("n", F.expr("exact_num div of")).withColumn("rest", F.col("exact_num") - F.col("n") * F.col("of"))
    left = (total - F.sum("n").over(w)).cast("long")
    rank = F.row_number().over(w.orderBy(F.desc("rest"), *order))
    return rows.withColumn("left", left).withColumn("n", (F.col("n") + (rank <= F.col("left")).cast("long")).cast("long")).drop("exact_num", "of", "rest", "left")


def path_sizes(routes: DataFrame, lengths: DataFrame) -> DataFrame:
    """Per route of a pair, the length-weighted mean of 1 over the number of its pair's routes that use a link."""
    links = routes.select("pair", "route", "link").distinct()
    users = F.count("*").over(Window.partitionBy("pair", "link"))
    sized = links.withColumn("users", users).join(lengths.select("link", "length_m"), "link")
    return sized.groupBy("pair", "route").agg(F.round(F.sum(F.col("length_m") / F.col("users")) / F.sum("length_m"), 6).alias("path_size"))


def overlaps(routes: DataFrame, lengths: DataFrame) -> DataFrame:
    """The greatest share of a route's length that it has in common with an earlier route of its pair."""
    links = routes.select("pair", "route", "link").distinct().join(lengths.select("link", "length_m"), "link")
    total = links.groupBy("pair", "route").agg(F.sum("length_m").alias("total"))
    earlier = links.select("pair", "link", F.col("route").alias("other"))
    common = links.join(earlier, ["pair", "link"]).filter("other < route").groupBy("pair", "route", "other").agg(F.sum("length_m").alias("common"))
    best = common.groupBy("pair", "route").agg(F.max("common").alias("common"))
    return total.join(best, ["pair", "route"], "left").select("pair", "route", F.round(F.coalesce("common", F.lit(0)) / F.col("total"), 6).alias("overlap"))


def offered(routes: DataFrame, limit: float = 0.5, most: int = 5) -> DataFrame:
    """Routes within (1 + limit) of their pair's least seconds, the fastest `most`; ties by length, links, route."""
    w = Window.partitionBy("pair")
    near = routes.withColumn("least", F.min("seconds").over(w)).filter(F.col("seconds") <= (1 + limit) * F.col("least"))
    rank = F.row_number().over(w.orderBy("seconds", "length_m", "n_links", "route"))
    return near.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= most).drop("least")


def reselects(seed: int, iteration: int, share: float, key: str) -> Column:
    """Whether a traveller chooses anew in this iteration."""
    return uniform(seed + iteration, key) < share


def self_regulated_steps(reports: DataFrame, fell: float = 0.2, rose: float = 1.5) -> DataFrame:
    """eta of each iteration, 1, 2, and then one growth an iteration; the step is 1 / eta.

    A growth is `fell` if the gap fell below the one before and `rose` if it rose, stayed or is not known. An iteration knows the gaps up to the
    second before it only, so the growth to the third counts as a rise, and each later one compares the gap two iterations back with the one before that.
    """
    order = Window.partitionBy("run").orderBy("iteration")
    n = F.row_number().over(order)
    grow = F.when(n == 1, 0.0).when((F.col("gap") < F.lag("gap").over(order)) & ~F.isnan("gap"), fell).otherwise(rose)
    rows = reports.withColumns({"n": n, "g": grow})
    seen = F.coalesce(F.sum("g").over(order.rowsBetween(Window.unboundedPreceding, -2)), F.lit(0.0))
    eta = F.when(F.col("n") <= 2, F.col("n").cast("double")).otherwise(2 + rose + seen)
    return rows.withColumn("eta", F.round(eta, 6)).withColumn("step", F.round(1 / F.col("eta"), 6)).drop("g", "n")


def converged(reports: DataFrame, tolerance: float, least: int = 4) -> DataFrame:
    """Adds whether the mean gap of the last three iterations is under the tolerance, from the fourth on."""
    order = Window.partitionBy("run").orderBy("iteration")
    mean3 = F.avg("gap").over(order.rowsBetween(-2, 0))
    n = F.row_number().over(order)
    return reports.withColumn("mean3", F.round(mean3, 6)).withColumn("converged", (n >= least) & (F.col("mean3") < tolerance))


def verdict(gap: Column, unfinished: Column) -> Column:
    return F.when(unfinished > 0.05, "poor").when(gap <= 0.05, "good").when(gap <= 0.15, "acceptable").otherwise("poor")
