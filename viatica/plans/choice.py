"""Queries on discrete choice and route sets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from viatica.functions import draws
from viatica.operators import choice as op
from viatica.plans.registry import query

U = "(CAST(0 AS DOUBLE) + CAST(-0.2 AS DOUBLE) * time_min + CAST(-1.2 AS DOUBLE) * cost_eur + CAST(-1 AS DOUBLE) * transfers)"
ALTS = f"a AS (SELECT *, {U} AS u FROM v_alternatives), t AS (SELECT *, max(u) OVER (PARTITION BY situation) AS top FROM a), e AS (SELECT *, exp(u - top) AS x FROM t), p AS (SELECT *, x / sum(x) OVER (PARTITION BY situation) AS p FROM e)"


def _with_u(alternatives):
    return alternatives.withColumn("u", op.utility())


@query(f"SELECT situation, alternative, round({U}, 6) AS u FROM v_alternatives", "v_alternatives")
def utilities_linear(alternatives):
    return _with_u(alternatives).select("situation", "alternative", F.round("u", 6).alias("u"))


@query("SELECT situation, alternative, round(CAST(-0.2 AS DOUBLE) * time_min + CAST(-0.05 AS DOUBLE) * time_min * cost_eur, 9) AS u FROM v_alternatives", "v_alternatives")
def utilities_product_terms(alternatives):
    return alternatives.select("situation", "alternative", F.round(op.utility({"time_min": -0.2, "time_min*cost_eur": -0.05}), 9).alias("u"))


@query(
    "SELECT situation, alternative, round(CASE class WHEN 1 THEN CAST(-0.1 AS DOUBLE) ELSE CAST(-0.2 AS DOUBLE) END * time_min + CASE class WHEN 2 THEN CAST(-0.4 AS DOUBLE) ELSE CAST(-1.2 AS DOUBLE) END * cost_eur + CASE class WHEN 1 THEN CAST(-2 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END * transfers, 6) AS u FROM v_alternatives",
    "v_alternatives",
)
def utilities_by_class(alternatives):
    betas = alternatives.sparkSession.createDataFrame([(1, "time_min", -0.1), (1, "transfers", -2.0), (2, "cost_eur", -0.4)], "class long, attribute string, beta double")
    return op.class_utility(alternatives, betas).select("situation", "alternative", F.round("u", 6).alias("u"))


@query(f"WITH {ALTS} SELECT situation, alternative, round(p, 6) AS p FROM p", "v_alternatives")
def logit_probabilities(alternatives):
    return op.logit(_with_u(alternatives)).select("situation", "alternative", F.round("p", 6).alias("p"))


@query(f"WITH {ALTS} SELECT situation, round(max(top) + ln(sum(x)), 6) AS logsum FROM e GROUP BY 1", "v_alternatives")
def logit_logsum(alternatives):
    return op.logsums(_with_u(alternatives)).select("situation", F.round("logsum", 6).alias("logsum"))


@query(
    f"""WITH a AS (SELECT *, {U} AS u FROM v_alternatives), n AS (SELECT situation, nest, max(u) AS top FROM a GROUP BY 1, 2),
e AS (SELECT a.*, top, exp((u - top) / CAST(0.5 AS DOUBLE)) AS x FROM a JOIN n USING (situation, nest)), i AS (SELECT situation, nest, sum(x) AS inn, max(top) + CAST(0.5 AS DOUBLE) * ln(sum(x)) AS v FROM e GROUP BY 1, 2),
b AS (SELECT situation, max(v) AS b FROM i GROUP BY 1), w AS (SELECT situation, nest, inn, exp(v - b) AS w FROM i JOIN b USING (situation)), z AS (SELECT situation, sum(w) AS z FROM w GROUP BY 1)
SELECT e.situation, alternative, round(x / inn * w / z, 6) AS p FROM e JOIN w USING (situation, nest) JOIN z ON z.situation = e.situation""",
    "v_alternatives",
)
def nested_logit_probabilities(alternatives):
    return op.nested_logit(_with_u(alternatives)).select("situation", "alternative", F.round("p", 6).alias("p"))


@query("SELECT situation, arg_min(alternative, time_min * 1000 + alternative) AS alternative FROM v_alternatives GROUP BY 1", "v_alternatives")
def deterministic_choice(alternatives):
    return op.first_best(alternatives, -F.col("time_min")).select("situation", "alternative")


@query(
    f"""WITH a AS (SELECT *, {U} AS u, md5('42:' || situation || ':' || alternative) AS m FROM v_alternatives),
g AS (SELECT *, round(u - ln(-ln((CAST(('0x' || substr(m, 1, 13)) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE))), 9) AS v FROM a)
SELECT situation, alternative FROM (SELECT *, row_number() OVER (PARTITION BY situation ORDER BY v DESC, alternative) AS n FROM g) WHERE n = 1""",
    "v_alternatives",
)
def gumbel_choice(alternatives):
    value = F.round(F.col("u") + op.gumbel(op.uniform(42, "situation", "alternative")), 9)
    return op.first_best(_with_u(alternatives), value).select("situation", "alternative")


@query(
    f"""WITH {ALTS}, c AS (SELECT situation, alternative, round(sum(p) OVER (PARTITION BY situation ORDER BY alternative), 9) AS c, max(alternative) OVER (PARTITION BY situation) AS last FROM p)
SELECT situation, min(alternative) AS alternative FROM c WHERE c > CAST((situation * 37 % 100) AS DOUBLE) / 100 OR alternative = last GROUP BY 1""",
    "v_alternatives",
)
def quota_choice(alternatives):
    return op.quota_pick(op.logit(_with_u(alternatives)), F.col("situation") * 37 % 100 / 100)


@query(
    """WITH w AS (SELECT situation, alternative, turn + 1 AS s, sum(turn + 1) OVER (PARTITION BY situation) AS o FROM v_alternatives), f AS (SELECT *, s * 100 // o AS n, s * 100 % o AS r FROM w),
k AS (SELECT *, 100 - sum(n) OVER (PARTITION BY situation) AS l, row_number() OVER (PARTITION BY situation ORDER BY r DESC, alternative) AS k FROM f)
SELECT situation, alternative, CAST(n + CASE WHEN k <= l THEN 1 ELSE 0 END AS BIGINT) AS n FROM k""",
    "v_alternatives",
)
def largest_remainders(alternatives):
    return op.apportion(alternatives, ["situation"], F.col("turn") + 1, F.lit(100), ["alternative"]).select("situation", "alternative", "n")


@query(
    """WITH d AS (SELECT DISTINCT pair, route, link FROM v_routes), u AS (SELECT pair, link, count(*) AS n FROM d GROUP BY 1, 2)
SELECT pair, route, round(sum(CAST(length_m AS DOUBLE) / n) / CAST(sum(length_m) AS DOUBLE), 6) AS path_size FROM d JOIN u USING (pair, link) JOIN v_links USING (link) GROUP BY 1, 2""",
    "v_routes",
    "v_links",
)
def route_path_sizes(routes, links):
    return op.path_sizes(routes, links)


@query(
    """WITH d AS (SELECT DISTINCT pair, route, link, length_m FROM v_routes JOIN v_links USING (link)), t AS (SELECT pair, route, sum(length_m) AS t FROM d GROUP BY 1, 2),
c AS (SELECT a.pair, a.route, b.route AS o, sum(a.length_m) AS c FROM d a JOIN d b ON a.pair = b.pair AND a.link = b.link AND b.route < a.route GROUP BY 1, 2, 3)
SELECT t.pair, t.route, round(CAST(coalesce(max(c), 0) AS DOUBLE) / CAST(max(t) AS DOUBLE), 6) AS overlap FROM t LEFT JOIN c ON t.pair = c.pair AND t.route = c.route GROUP BY 1, 2""",
    "v_routes",
    "v_links",
)
def route_max_overlap(routes, links):
    return op.overlaps(routes, links)


ROUTE_COSTS = "rc AS (SELECT pair, route, CAST(sum(length_m) AS BIGINT) AS length_m, CAST(sum(length_m // 10 + 7 * (link % 5)) AS BIGINT) AS seconds, CAST(count(*) AS BIGINT) AS n_links FROM v_routes JOIN v_links USING (link) GROUP BY 1, 2)"


def _route_costs(routes, links):
    timed = routes.join(links, "link").withColumn("s", F.expr("length_m div 10") + 7 * (F.col("link") % 5))
    return timed.groupBy("pair", "route").agg(F.sum("length_m").alias("length_m"), F.sum("s").alias("seconds"), F.count("*").alias("n_links"))


@query(f"WITH {ROUTE_COSTS} SELECT * FROM rc", "v_routes", "v_links")
def route_costs(routes, links):
    return _route_costs(routes, links)


@query(
    f"""WITH {ROUTE_COSTS}, m AS (SELECT *, min(seconds) OVER (PARTITION BY pair) AS least FROM rc)
SELECT pair, route, seconds, length_m, n_links, rank FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY seconds, length_m, n_links, route) AS rank FROM m WHERE seconds <= 1.5 * least) WHERE rank <= 2""",
    "v_routes",
    "v_links",
)
def offered_routes(routes, links):
    return op.offered(_route_costs(routes, links), 0.5, 2).select("pair", "route", "seconds", "length_m", "n_links", "rank")


@query(
    f"""WITH {ROUTE_COSTS} SELECT CAST(count(DISTINCT pair) AS BIGINT) AS pairs, round(CAST(count(*) AS DOUBLE) / count(DISTINCT pair), 6) AS routes_per_pair,
round(quantile_cont(seconds, 0.95), 6) AS p95_seconds FROM rc""",
    "v_routes",
    "v_links",
)
def route_set_summary(routes, links):
    return _route_costs(routes, links).agg(F.countDistinct("pair").alias("pairs"), F.round(F.count("*") / F.countDistinct("pair"), 6).alias("routes_per_pair"), F.round(F.percentile("seconds", 0.95), 6).alias("p95_seconds"))


GAP = f"""{ALTS}, ch AS (SELECT *, row_number() OVER (PARTITION BY situation ORDER BY turn, alternative) = 1 AS taken FROM p),
gt AS (SELECT situation, max(class) FILTER (WHERE taken) AS class, max(time_min) FILTER (WHERE taken) AS g_chosen, min(time_min) AS g_best, sum(p * time_min) AS g_expected, max(p) FILTER (WHERE taken) / max(p) AS p_ratio FROM ch GROUP BY 1)"""


def _gap_trips(alternatives):
    rows = op.logit(_with_u(alternatives))
    taken = F.row_number().over(Window.partitionBy("situation").orderBy("turn", "alternative")) == 1
    rows = rows.withColumn("taken", taken)
    chosen = lambda c: F.max(F.when(F.col("taken"), F.col(c)))
    return rows.groupBy("situation").agg(chosen("class").alias("class"), chosen("time_min").alias("g_chosen"), F.min("time_min").alias("g_best"), F.sum(F.col("p") * F.col("time_min")).alias("g_expected"), (chosen("p") / F.max("p")).alias("p_ratio"))


@query(f"WITH {GAP} SELECT situation, class, g_chosen, g_best, round(g_expected, 6) AS g_expected, round(p_ratio, 6) AS p_ratio FROM gt", "v_alternatives")
def gap_trips(alternatives):
    return _gap_trips(alternatives).select("situation", "class", "g_chosen", "g_best", F.round("g_expected", 6).alias("g_expected"), F.round("p_ratio", 6).alias("p_ratio"))


@query(f"WITH {GAP} SELECT class, CAST(count(*) AS BIGINT) AS trips, sum(g_chosen) AS chosen_min, sum(g_best) AS best_min, sum(g_chosen - g_best) AS excess_min FROM gt GROUP BY 1", "v_alternatives")
def gap_pairs(alternatives):
    return _gap_trips(alternatives).groupBy("class").agg(F.count("*").alias("trips"), F.sum("g_chosen").alias("chosen_min"), F.sum("g_best").alias("best_min"), F.sum(F.col("g_chosen") - F.col("g_best")).alias("excess_min"))


@query(f"WITH {GAP} SELECT round(sum(g_chosen - g_best) / nullif(sum(g_best), 0), 6) AS gap FROM gt", "v_alternatives")
def gap_pairs_relative(alternatives):
    return _gap_trips(alternatives).agg(F.round(F.sum(F.col("g_chosen") - F.col("g_best")) / F.nullif(F.sum("g_best"), F.lit(0.0)), 6).alias("gap"))


@query(
    f"""WITH {ALTS}, ch AS (SELECT *, row_number() OVER (PARTITION BY situation ORDER BY turn, alternative) = 1 AS taken FROM p),
r AS (SELECT nest, class, sum(CASE WHEN taken THEN 1 ELSE 0 END) AS seen, sum(p) AS want FROM ch GROUP BY 1, 2) SELECT round(sum(abs(seen - want)) / 2 / sum(seen), 6) AS flow_gap FROM r""",
    "v_alternatives",
)
def flow_gap(alternatives):
    rows = op.logit(_with_u(alternatives))
    seen = F.when(F.row_number().over(Window.partitionBy("situation").orderBy("turn", "alternative")) == 1, 1).otherwise(0)
    by_route = rows.withColumn("seen", seen).groupBy("nest", "class").agg(F.sum("seen").alias("seen"), F.sum("p").alias("want"))
    return by_route.agg(F.round(F.sum(F.abs(F.col("seen") - F.col("want"))) / 2 / F.sum("seen"), 6).alias("flow_gap"))


REPORTS = "r AS (SELECT l_suppkey AS run, CAST(l_linenumber AS BIGINT) AS iteration, CAST(max(l_partkey) % 97 AS DOUBLE) / 100 AS gap FROM lineitem GROUP BY 1, 2)"


def _reports(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.groupBy(F.col("l_suppkey").alias("run"), F.col("l_linenumber").cast("long").alias("iteration")).agg((F.max("l_partkey") % 97 / 100).alias("gap"))


@query(
    f"""WITH {REPORTS}, k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY iteration) - 1 AS k FROM r), c AS (SELECT a.run, a.k, CASE WHEN a.gap < b.gap THEN 2e-1 ELSE 15e-1 END AS g FROM k a JOIN k b ON b.run = a.run AND b.k = a.k - 1),
e AS (SELECT k.run, k.iteration, k.gap, round(CASE WHEN k.k = 0 THEN 1e0 WHEN k.k = 1 THEN 2e0 ELSE 35e-1 + coalesce((SELECT sum(g) FROM c WHERE c.run = k.run AND c.k <= k.k - 2), 0) END, 6) AS eta FROM k) SELECT run, iteration, gap, eta, round(1 / eta, 6) AS step FROM e"""
)
def self_regulated_averaging(spark, sf_dir):
    return op.self_regulated_steps(_reports(spark, sf_dir))


@query(
    f"""WITH {REPORTS}, m AS (SELECT *, round(avg(gap) OVER (PARTITION BY run ORDER BY iteration ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS mean3, row_number() OVER (PARTITION BY run ORDER BY iteration) AS n FROM r)
SELECT run, iteration, gap, mean3, n >= 4 AND mean3 < 0.6 AS converged FROM m"""
)
def convergence_test(spark, sf_dir):
    return op.converged(_reports(spark, sf_dir), 0.6)


@query(f"WITH {REPORTS} SELECT run, iteration, CASE WHEN CAST(run % 10 AS DOUBLE) / 100 > 0.05 THEN 'poor' WHEN gap <= 0.05 THEN 'good' WHEN gap <= 0.15 THEN 'acceptable' ELSE 'poor' END AS verdict FROM r")
def convergence_verdict(spark, sf_dir):
    return _reports(spark, sf_dir).select("run", "iteration", op.verdict(F.col("gap"), F.col("run") % 10 / 100).alias("verdict"))


@query("SELECT DISTINCT situation FROM v_alternatives WHERE (CAST(('0x' || substr(md5('7:' || situation), 1, 13)) AS BIGINT) + 5e-1) / CAST(4503599627370496 AS DOUBLE) < 25e-2", "v_alternatives")
def msa_reselection(alternatives):
    """Who chooses anew in iteration 3, where the share is 1 / (3 + 1)."""
    return alternatives.select("situation").distinct().filter(op.reselects(4, 3, 0.25, "situation"))


def _mixed_sql(rows: str, key: bytes) -> str:
    """SQL for the first word of the ChaCha8 block at address (a, b, c, d) of rows (id, a, b, c, d): a CTE a quarter round."""
    words = [*draws.CONSTANTS.tolist(), *np.frombuffer(key, "<u4").tolist()]
    turned = lambda x, n: f"((({x}) << {n}) | (({x}) >> {32 - n})) & 4294967295"
    out = [f"z0 AS MATERIALIZED (SELECT id, {', '.join(f'CAST({w} AS BIGINT) AS x{i}' for i, w in enumerate(words))}, CAST(d AS BIGINT) AS x12, CAST(c AS BIGINT) AS x13, CAST(b AS BIGINT) AS x14, CAST(a AS BIGINT) AS x15 FROM {rows})"]
    n = 0
    for _ in range(4):
        for a, b, c, d in draws.COLUMNS_THEN_DIAGONALS:
            for u, v, w, turn in ((a, b, d, 16), (c, d, b, 12), (a, b, d, 8), (c, d, b, 7)):
                others = ", ".join(f"x{i}" for i in range(16) if i not in (u, w))
                total = f"(x{u} + x{v}) & 4294967295"
                out.append(f"z{n + 1} AS MATERIALIZED (SELECT id, {others}, {total} AS x{u}, {turned(f'xor(x{w}, {total})', turn)} AS x{w} FROM z{n})")
                n += 1
    return ", ".join(out) + f", zw AS (SELECT id, (x0 + {words[0]}) & 4294967295 AS word FROM z{n})"


KEY = draws.key(42, "choice")


@query(
    f"""WITH a AS (SELECT *, {U} AS u, situation * 1000 + alternative AS id FROM v_alternatives), ad AS (SELECT id, situation AS a, 0 AS b, 3 AS c, alternative AS d FROM a), {_mixed_sql('ad', KEY)}
SELECT situation, alternative FROM (SELECT situation, alternative, row_number() OVER (PARTITION BY situation ORDER BY round(u - ln(-ln((word + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE))), 9) DESC, alternative) AS n FROM a JOIN zw USING (id)) WHERE n = 1""",
    "v_alternatives",
)
def keyed_gumbel_choice(alternatives):
    """The highest utility with a Gumbel draw addressed by situation, trip 0, iteration 3 and alternative."""
    rows = _with_u(alternatives).withColumn("word", draws.word(KEY, "situation", F.lit(0), F.lit(3), "alternative"))
    return op.first_best(rows, F.round(F.col("u") + draws.gumbel(F.col("word")), 9)).select("situation", "alternative")
