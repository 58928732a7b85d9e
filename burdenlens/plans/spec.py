"""Parameters of an analysis."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

SCOPES = ("monogenic", "digenic")
SCALES = ("gene", "variant")
DEFAULT_TOP = 1000


@dataclass(frozen=True, eq=False)
class AnalysisSpec:
    """One ranking.

    case, control
        Predicates that select the rows of each group: SQL text or a Column. The empty text is
        every row; ``control=None`` is an analysis without control group.
    case_max_freq, control_max_freq, strict_freq
        Variants carried by a larger share of a group are left out before scoring (with
        ``strict_freq`` also those at the limit).
    burden
        ``'variants'`` or ``'alleles'`` carried, per gene and sample.
    test
        ``'fisher'`` on carrier counts or ``'ttest'`` on doses. Default: t-test for single
        variants, Fisher otherwise. Pairs only know Fisher.
    fisher_table, t_tail
        ``'standard'`` or ``'compat'``; ``'halved'`` or ``'greater'``.
    min_score
        Only scores above it are kept. ``'mode'`` (default): 0 for Fisher on genes and gene
        pairs, none otherwise. ``None``: keep all.
    top_k
        Length of the ranking, ``None`` for all of it. A cut ranking is merged in one task, as a
        report is; ask for all of it rather than for millions of rows.
    on_overlap
        What to do about samples in both groups: ``'raise'`` or ``'exclude'``.
    cohort
        Sample list ``(sample_id, is_case)``. Groups and their sizes are then read from it,
        instead of from the samples that have a row left after the predicates.
    deduplicated
        The table is known to hold one row per (gene, variant, sample): skip that aggregation.
    """

    name: str
    case: str | Column
    control: str | Column | None
    scope: str = "monogenic"
    scale: str = "gene"
    case_max_freq: float = 0.5
    control_max_freq: float = 0.5
    strict_freq: bool = False
    burden: str = "variants"
    test: str | None = None
    fisher_table: str = "standard"
    t_tail: str = "halved"
    min_score: float | str | None = "mode"
    top_k: int | None = DEFAULT_TOP
    on_overlap: str = "raise"
    cohort: DataFrame | None = None
    deduplicated: bool = False
    case_name: str = "case"
    control_name: str = "control"

    def __post_init__(self):
        _one_of("scope", self.scope, SCOPES)
        _one_of("scale", self.scale, SCALES)
        _one_of("burden", self.burden, ("variants", "alleles"))
        _one_of("fisher_table", self.fisher_table, ("standard", "compat"))
        _one_of("t_tail", self.t_tail, ("halved", "greater"))
        _one_of("on_overlap", self.on_overlap, ("raise", "exclude"))
        if self.test is not None:
            _one_of("test", self.test, ("fisher", "ttest"))
        if self.scope == "digenic" and self.test == "ttest":
            raise ValueError("pairs are scored with Fisher's test only")

    @property
    def effective_test(self) -> str:
        if self.test is not None:
            return self.test
        return "ttest" if (self.scope, self.scale) == ("monogenic", "variant") else "fisher"

    @property
    def effective_min_score(self) -> float | None:
        if self.min_score != "mode":
            return self.min_score
        return 0.0 if self.scale == "gene" and self.effective_test == "fisher" else None

    @property
    def key_columns(self) -> list[str]:
        """Columns that identify a ranked item."""
        if self.scope == "digenic":
            stem = "gene_symbol" if self.scale == "gene" else "variant_id"
            return [f"{stem}1", f"{stem}2"]
        return ["gene_symbol"] if self.scale == "gene" else ["variant_id", "gene_symbol"]


def _one_of(name: str, value: str, allowed: tuple[str, ...]) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}")
