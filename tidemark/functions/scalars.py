"""Check digits and bands as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tables of Verhoeff's scheme over the dihedral group of order ten.
_PERMUTE = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)


def _dihedral(a: int, b: int) -> int:
    """The product of two elements: rotations are 0 .. 4, reflections 5 .. 9."""
    if a < 5:
        return (a + b) % 5 if b < 5 else 5 + (a + b) % 5
    return 5 + (a - b) % 5 if b < 5 else (a - b) % 5


def _tables() -> tuple[list[int], list[int]]:
    rows = [list(range(10))]
    for _ in range(7):
        rows.append([_PERMUTE[x] for x in rows[-1]])
    return [_dihedral(a, b) for a in range(10) for b in range(10)], [x for r in rows for x in r]


def verhoeff_valid(number: Column) -> Column:
    """Whether the last digit is the scheme's check digit of the others."""
    product, permuted = (F.array(*map(F.lit, t)) for t in _tables())
    digits = F.transform(F.split(F.reverse(number), ""), lambda d, i: permuted[(i % 8) * 10 + d.cast("int")])
    return F.aggregate(digits, F.lit(0), lambda c, d: product[c * 10 + d]) == 0


def iban_valid(iban: Column) -> Column:
    """The remainder by 97 of 5 to 34 letters and digits: blanks don't count, letters are 10 .. 35, the first four characters go last."""
    compact = F.upper(F.replace(iban, F.lit(" "), F.lit("")))
    moved = F.concat(F.substr(compact, F.lit(5)), F.substring(compact, 1, 4))
    values = F.transform(
        F.split(moved, ""),
        lambda c: F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).when(c.rlike("^[A-Z]$"), F.ascii(c) - 55),
    )
    rest = F.aggregate(values, F.lit(0), lambda a, v: (F.when(v > 9, a * 100 + v).otherwise(a * 10 + v) % 97).cast("int"))
    return F.coalesce(compact.rlike("^[0-9A-Z]{5,34}$") & (rest == 1), F.lit(False))


def owasp_band(factor: Column) -> Column:
    return F.when(factor < 3, "low").when(factor < 6, "medium").otherwise("high")
