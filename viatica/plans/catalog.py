"""Every query by name, with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from viatica.plans import assembly, chains, choice, demand, frozen, growth, kernels, loading, maps, network, planning, readings, results, routing, scalars, services, transit, walks  # noqa: F401  each module registers its queries
from viatica.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
