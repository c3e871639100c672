"""Rounding of scores for display."""

from decimal import Decimal

from pyspark.sql import functions as F

# The doubles next to 0.005, 0.015, ... 1.005, and whether a score that equals one is
# rounded up: above the true middle yes, below no, exactly on it to the even digit.
_MIDDLES = [float(Decimal(2 * k + 1) / 200) for k in range(101)]
_ROUND_UP = [Decimal(m) > Decimal(2 * k + 1) / 200 or (Decimal(m) == Decimal(2 * k + 1) / 200 and k % 2 == 1)
             for k, m in enumerate(_MIDDLES)]


def round_score(c):
    """A score of 0..1 with two digits, decided by its exact binary value.

    ``round`` and ``bround`` decide by the shortest decimal text, which differs for
    values such as 0.445.
    """
    k = F.least(F.floor(c * 100), F.lit(100)).cast("int")
    middle = F.get(F.expr("array(" + ", ".join(f"{m!r}D" for m in _MIDDLES) + ")"), k)
    up = F.get(F.expr("array(" + ", ".join(str(u).lower() for u in _ROUND_UP) + ")"), k)
    return (k + ((c > middle) | ((c == middle) & up)).cast("int")) / 100
