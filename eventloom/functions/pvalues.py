"""P-values of rank tests: small helpers for results of a few rows."""

from __future__ import annotations

import math


def wilcoxon_p(w_plus: float, n: int, ties: float = 0.0, exact: bool = True) -> float | None:
    """Two-sided p of a signed-rank sum: exact for n of 50 at most without ties, else by the normal approximation; None for n = 0."""
    if not n:
        return None
    if exact and n <= 50 and not ties and float(w_plus).is_integer():
        ways = [1] + [0] * (n * (n + 1) // 2)
        for r in range(1, n + 1):
            for s in range(len(ways) - 1, r - 1, -1):
                ways[s] += ways[s - r]
        low = min(int(w_plus), len(ways) - 1 - int(w_plus))
        return min(1.0, 2 * sum(ways[: low + 1]) / 2**n)
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return math.erfc(abs(w_plus - mean) / math.sqrt(2 * var)) if var > 0 else 1.0


def student_p(t: float, df: int) -> float | None:
    """Two-sided p of Student's t, by the incomplete beta function's continued fraction; None for df < 1."""
    if df < 1 or t is None or math.isnan(t):
        return None
    if math.isinf(t):
        return 0.0
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x in (0.0, 1.0):
        return x

    def fraction(x: float, a: float, b: float) -> float:
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                c = 1 + num / c
                d = 1 / (d if abs(d) > 1e-300 else 1e-300)
                c = c if abs(c) > 1e-300 else 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def spearman_p(rho: float, n: int) -> float | None:
    """Two-sided p of a rank correlation over n pairs."""
    if n < 3 or rho is None:
        return None
    return 0.0 if abs(rho) >= 1 else student_p(rho * math.sqrt((n - 2) / (1 - rho * rho)), n - 2)
