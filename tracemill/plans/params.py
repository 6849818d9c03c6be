"""Miner settings. A list of settings is part of the plan: its rows are literals, so one job
answers all of them without a join."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class HeuristicParams:
    dependency: float = 0.5
    min_frequency: int = 1

    def __post_init__(self):
        if self.dependency <= 0 and self.min_frequency < 1:
            raise ValueError(
                "min_frequency must be at least 1 when dependency is 0 or less: every pair of "
                "activities that never meets would be an edge"
            )


@dataclass(frozen=True)
class FuzzyParams:
    significance: float = 0.0
    correlation: float = 0.0
    edge_cutoff: float = 0.0
    utility_ratio: float = 0.0

    def __post_init__(self):
        for f in fields(self):
            if not 0 <= getattr(self, f.name) <= 1:
                raise ValueError(f"{f.name} must be between 0 and 1")

    @property
    def filters_edges(self) -> bool:
        return not (self.edge_cutoff == 0 and self.utility_ratio == 0)


def param_rows(params: Sequence) -> Column:
    """An array of structs ``param_id, <settings>``; ids count from 0 in the order given."""

    def literal(value) -> str:
        return f"{value}L" if isinstance(value, int) else f"{float(value)!r}D"

    rows = []
    for i, p in enumerate(params):
        settings = {f.name: (int if f.type == "int" else float)(getattr(p, f.name)) for f in fields(p)}
        named = [f"'{name}', {literal(v)}" for name, v in {"param_id": i, **settings}.items()]
        rows.append(f"named_struct({', '.join(named)})")
    return F.expr(f"array({', '.join(rows)})")
