"""Plain-Python statements of what the engine computes, for small inputs."""

from __future__ import annotations

import math
from collections import defaultdict
from fractions import Fraction
from itertools import combinations


def fisher(a, n_case, c, n_control, table="standard"):
    """Exact one-sided p-value from whole numbers."""
    r2 = n_control if table == "standard" else n_control + c
    m, n = a + c, n_case + r2
    ways = sum(
        math.comb(n_case, x) * math.comb(r2, m - x)
        for x in range(a, min(n_case, m) + 1)
        if 0 <= m - x <= r2
    )
    return float(Fraction(ways, math.comb(n, m)))


def t_inside(t, df):
    """P(|T| < |t|) for whole df by the finite trigonometric series."""
    theta = math.atan(abs(t) / math.sqrt(df))
    square = math.cos(theta) ** 2
    odd = df % 2
    term = total = 0.0
    for i in range((df - 1) // 2 if odd else df // 2):
        if i == 0:
            term = 1.0
        else:
            term *= square * ((2 * i) / (2 * i + 1) if odd else (2 * i - 1) / (2 * i))
        total += term
    if odd:
        return 2 / math.pi * (theta + math.sin(theta) * math.cos(theta) * total)
    return math.sin(theta) * total


def t_halved(case, control):
    """Pooled two-sample t-test on two lists of values, two-sided p halved; None if constant."""
    n1, n2 = len(case), len(control)
    m1, m2 = sum(case) / n1, sum(control) / n2
    ss = sum((x - m1) ** 2 for x in case) + sum((x - m2) ** 2 for x in control)
    df = n1 + n2 - 2
    if ss == 0 or df <= 0:
        return None
    t = (m1 - m2) / math.sqrt(ss / df * (1 / n1 + 1 / n2))
    return (1 - t_inside(t, df)) / 2


class Calls:
    """Rows (sample, variant, gene, dose); cases start with A, controls with B."""

    def __init__(self, rows):
        self.dose = {}
        for sample, variant, gene, dose in rows:
            key = (gene, variant, sample)
            self.dose[key] = max(dose, self.dose.get(key, 0))
        samples = {s for _, _, s in self.dose}
        self.cases = sorted(s for s in samples if s.startswith("A"))
        self.controls = sorted(s for s in samples if s.startswith("B"))

    def within(self, max_case, max_control, strict=False):
        """Calls of variants within the frequency limits."""
        carriers = defaultdict(set)
        for gene, variant, sample in self.dose:
            carriers[gene, variant].add(sample)
        kept = set()
        for key, who in carriers.items():
            rc = len(who & set(self.cases)) / max(len(self.cases), 1)
            rk = len(who & set(self.controls)) / max(len(self.controls), 1)
            fine = rc < max_case and rk < max_control if strict else rc <= max_case and rk <= max_control
            if fine:
                kept.add(key)
        return {k: d for k, d in self.dose.items() if k[:2] in kept}

    def rank(self, sums):
        """Rows (item, score, ratio_case, ratio_control, sum_case, sum_control)."""
        out = []
        for item, (a, c) in sums.items():
            rc, rk = a / len(self.cases), c / len(self.controls)
            out.append((item, rc - rk, rc, rk, a, c))
        return sorted(out, key=lambda r: (-r[1], r[0]))

    def gene_fisher(self, *limits, **options):
        who = defaultdict(set)
        for gene, _, sample in self.within(*limits, **options):
            who[gene].add(sample)
        return [r for r in self.rank(self._sums(who)) if r[1] > 0]

    def pairs(self, part, *limits):
        """Pairs of genes (part 0) or variants (part 1) with a common carrier."""
        who = defaultdict(set)
        for key in self.within(*limits):
            who[key[part]].add(key[2])
        both = {}
        for x, y in combinations(sorted(who), 2):
            if who[x] & who[y]:
                both[(y, x) if part == 0 else (x, y)] = who[x] & who[y]
        return self.rank(self._sums(both))

    def _sums(self, who):
        cases, controls = set(self.cases), set(self.controls)
        return {k: (len(v & cases), len(v & controls)) for k, v in who.items()}
