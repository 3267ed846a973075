"""What a deployment allows, and when a finding is one too many."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("info", "low", "medium", "high", "critical")
#: Budgets that are part of the results.
ROUNDS, VARIANTS, INGRESS_VARIANTS, DECODE_DEPTH, RUNS, RUN_LENGTH = 4, 96, 24, 8, 16, 8
PRINTABLE, TEXT_BYTES, CANARY_LENGTH, RING, VIEW_EVENTS, VIEW_FINDINGS = 0.85, 65_536, 8, 4096, 4000, 1000
LAYERS = ("normalize", "ingress", "provenance", "toolauth", "egress")


@dataclass(frozen=True)
class Policy:
    """Small by nature: it is made into literals of the plan. Raises ValueError for a canary that is too short.

    The threshold may be spelt in either case.
    """

    block_threshold: str = "high"
    strict_data: bool = True
    canaries: tuple[str, ...] = ()
    allowed_hosts: tuple[str, ...] = ()
    forbidden_effects: tuple[str, ...] = ()
    layers: frozenset[str] = field(default_factory=lambda: frozenset(LAYERS))

    def __post_init__(self) -> None:
        object.__setattr__(self, "block_threshold", self.block_threshold.lower())
        if self.block_threshold not in SEVERITIES:
            raise ValueError(f"no such severity: {self.block_threshold}")
        for canary in self.canaries:
            if len(re.sub("[^A-Za-z0-9]", "", canary)) < CANARY_LENGTH:
                raise ValueError(f"a canary needs {CANARY_LENGTH} letters or digits")


def listed(value: str | None) -> tuple[str, ...]:
    """Entries of a setting that are divided by commas, blanks or tabs."""
    return tuple(x for x in re.split("[, \t]+", value or "") if x)


class Rules(NamedTuple):
    """What a policy says, as columns: of literals where one policy holds for all rows, or of each row's own policy."""

    threshold: Column
    strict: Column
    canaries: Column
    allowed_hosts: Column
    forbidden_effects: Column


def rules(policy: Policy | Rules) -> Rules:
    if isinstance(policy, Rules):
        return policy
    listed_ = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    return Rules(F.lit(policy.block_threshold), F.lit(policy.strict_data), listed_(policy.canaries), listed_(policy.allowed_hosts), listed_(policy.forbidden_effects))


def row_rules() -> Rules:
    """Rules of rows that carry ``policy``, a struct of these fields."""
    return Rules(*(F.col(f"policy.{c}") for c in ("block_threshold", "strict_data", "canaries", "allowed_hosts", "forbidden_effects")))
