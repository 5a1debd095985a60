"""What can be named: choice models, route methods, strategies, and the parameters with their defaults; models of one's own by name."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from viatica.operators import choice, readings, routing, statics

#: A choice model: rows (situation, alternative, u, nest) and a draw by situation to the alternative chosen (situation, alternative).
Model = Callable[[DataFrame, Column], DataFrame]


def _logit(rows: DataFrame, draw: Column) -> DataFrame:
    return readings.cumulative_choice(choice.logit(rows), draw)


def _nested(rows: DataFrame, draw: Column) -> DataFrame:
    return readings.cumulative_choice(choice.nested_logit(rows), draw)


def _best(rows: DataFrame, draw: Column) -> DataFrame:
    return choice.first_best(rows, F.col("u")).select("situation", "alternative")


_MODELS: dict[str, Model] = {"logit": _logit, "nested_logit": _nested, "deterministic": _best}


def register_model(name: str, model: Model) -> None:
    """Adds a model of one's own; a name that is taken is refused."""
    if name in _MODELS:
        raise ValueError(f"{name} is taken")
    _MODELS[name] = model


def choose(rows: DataFrame, model: str, seed: int) -> DataFrame:
    """The choices of a model by name, with draws addressed by seed and situation."""
    if model not in _MODELS:
        raise ValueError(f"no choice model {model}: {', '.join(choice_models())}")
    return _MODELS[model](rows, choice.uniform(seed, "situation"))


def random_utility(rows: DataFrame, seed: int) -> DataFrame:
    """The alternative with the greatest utility (u) and Gumbel draw, addressed by seed, situation and alternative, the first of a tie."""
    noisy = rows.withColumn("noisy", F.col("u") + choice.gumbel(choice.uniform(seed, "situation", "alternative")))
    return choice.first_best(noisy, F.col("noisy")).select("situation", "alternative")


def choice_models() -> list[str]:
    return sorted(_MODELS)


def route_methods() -> list[str]:
    return sorted(routing.METHODS)


def equilibration_strategies() -> list[str]:
    return sorted(statics.STRATEGIES)


# Parameters, their defaults and units.
PARAMETERS = [
    ("link_penalty", "penalty", 1.5, ""),
    ("link_penalty", "max_detour", 1.3, ""),
    ("link_penalty", "max_overlap", 0.75, ""),
    ("link_penalty", "max_paths", 5.0, "routes"),
    ("simulation", "draws", 16.0, ""),
    ("simulation", "sigma", 4.0, ""),
    ("simulation", "max_detour", 2.0, ""),
    ("simulation", "max_overlap", 0.9, ""),
    ("simulation", "max_paths", 10.0, "routes"),
    ("free_flow", "increments", 5.0, ""),
    ("sra", "eta_fell", 0.2, ""),
    ("sra", "eta_rose", 1.5, ""),
]


def parameters(spark: SparkSession, changed: Mapping[str, float] | None = None) -> DataFrame:
    """(group, name, value, unit) of all parameters, with those of `changed` (group.name) in place of their defaults; an unknown one is refused."""
    changed = dict(changed or {})
    if unknown := sorted(set(changed) - {f"{g}.{n}" for g, n, _, _ in PARAMETERS}):
        raise ValueError(f"no parameter {', '.join(unknown)}")
    return spark.createDataFrame([(g, n, float(changed.get(f"{g}.{n}", v)), u) for g, n, v, u in PARAMETERS], "group string, name string, value double, unit string")
