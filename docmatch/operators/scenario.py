"""Scenario parameters: per-project tables and a single-scenario record."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIRECTIONS = ("forward", "reverse", "both")


@dataclass(frozen=True)
class Scenario:
    """Parameters of one matching job; the defaults are the service's domain defaults."""

    # The names and defaults of the scenario fields are the interface.
    role_desc: str = ""
    reference_desc: str = ""
    input_desc: str = ""
    scoring_rule: str = ""
    direction: str = "forward"
    rag_k: int = 5
    rag_k_forward: int | None = None
    rag_k_reverse: int | None = None
    cof_threshold: float = 0.5
    reference_depth: int = 1
    input_depth: int = 1
    chunk_size: int = 0
    llm_name: str | None = None
    max_prompt_tokens: int = 8000

    def __post_init__(self) -> None:
        if self.direction.lower() not in DIRECTIONS:
            raise ValueError(f"direction must be one of {DIRECTIONS}")
        if not 0.0 <= self.cof_threshold <= 1.0:
            raise ValueError("cof_threshold must be between 0 and 1")

    def legs(self) -> tuple[str, ...]:
        """The searches to run: ``both`` is forward, then reverse."""
        direction = self.direction.lower()
        return ("forward", "reverse") if direction == "both" else (direction,)

    def k(self, leg: str) -> int:
        """The leg's own k, else the general one; at least 1."""
        own = self.rag_k_forward if leg == "forward" else self.rag_k_reverse
        return max(1, self.rag_k if own is None else own)


def resolve(user: DataFrame, defaults: Scenario = Scenario()) -> DataFrame:
    """User values over defaults, column by column; NULL never overrides a default."""
    kinds = {
        "rag_k": "int", "rag_k_forward": "int", "rag_k_reverse": "int", "cof_threshold": "double",
        "reference_depth": "int", "input_depth": "int", "chunk_size": "int", "max_prompt_tokens": "int",
    }
    resolved = {}
    for name, value in vars(defaults).items():
        kind = kinds.get(name, "string")
        base = F.lit(value).cast(kind)
        resolved[name] = F.coalesce(F.col(name).cast(kind), base) if name in user.columns else base
    resolved["direction"] = F.lower(resolved["direction"])
    return user.withColumns(resolved)


def effective_k(leg: Column) -> Column:
    """k of a search over resolved scenario columns; at least 1."""
    own = F.when(leg == "forward", F.col("rag_k_forward")).when(leg == "reverse", F.col("rag_k_reverse"))
    return F.greatest(F.lit(1), F.coalesce(own, F.col("rag_k")))


def searched_side(leg: Column) -> Column:
    """Reverse looks among inputs, every other direction among references."""
    return F.when(leg == "reverse", "input").otherwise("reference")
