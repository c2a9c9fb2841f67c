"""All registered queries: importing a plan module registers its queries."""

from prefloom.plans import compare, pairq, prep, requestq, rewardq, rolloutq, sourceq, textq  # noqa: F401
from prefloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
