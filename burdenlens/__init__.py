"""Case/control variant scoring as Spark DataFrame plans."""

from burdenlens.plans.score import (
    case_exclusive_variants,
    count_difference,
    number_of_tests,
    score,
    with_rank,
)
from burdenlens.plans.spec import AnalysisSpec

__all__ = [
    "AnalysisSpec",
    "case_exclusive_variants",
    "count_difference",
    "number_of_tests",
    "score",
    "with_rank",
]
