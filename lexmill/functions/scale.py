"""The six difficulty bands and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bands in ascending order; their ranks are 1 to 6.
BANDS = ("A1", "A2", "B1", "B2", "C1", "C2")
#: Highest rank of supporting words, and of the words of a text, for a passage of rank 1 to 6.
CEILINGS = {"support": (3, 3, 4, 5, 6, 6), "text": (4, 4, 5, 6, 6, 6)}


def rank(band: Column) -> Column:
    """1 to 6; null for anything else."""
    at = F.array_position(F.array(*map(F.lit, BANDS)), F.upper(F.trim(band)))
    return F.when(at > 0, at.cast("int"))


def band(rank_: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, BANDS)), rank_.cast("int"))


def ceiling_rank(passage_rank: Column, mode: str = "support") -> Column:
    """Unknown passages count as B1."""
    return F.element_at(F.array(*map(F.lit, CEILINGS[mode])), F.coalesce(passage_rank, F.lit(3)).cast("int"))


def ceiling(passage: Column, mode: str = "support") -> Column:
    return band(ceiling_rank(rank(passage), mode))


def tier(passage: Column) -> Column:
    c = F.upper(F.trim(F.coalesce(passage, F.lit(""))))
    return F.when(c.isin("A1", "A2", "A2+"), "foundational").when(c.isin("B1", "B1+", "B2", "B2+"), "intermediate").otherwise("advanced")


def ladder(value: Column, steps: tuple[float, ...]) -> Column:
    """The band whose step value doesn't exceed."""
    out = F.lit(BANDS[len(steps)])
    for b, top in reversed(list(zip(BANDS, steps, strict=False))):
        out = F.when(value <= top, F.lit(b)).otherwise(out)
    return out


def text_band(avg: Column, bonus: Column, p80: Column, p90: Column, b2: Column, c1: Column, c2_count: Column, c2: Column) -> Column:
    """Band of a text of eight types or more from the mean of its types' levels, the complexity bonus, index percentiles
    and the shares of types from 3.5, 4.5 and 5.3 on."""
    eff = avg + bonus
    bridge = (bonus >= 0.14) & (eff >= 2.68) & (p90 >= 4.0) & (c2_count >= 14) & (c2 >= 0.05)
    return (
        F.when((avg <= 1.82) & (p80 <= 2.5) & (b2 < 0.05), "A1")
        .when((avg <= 2.14) & (p80 <= 3.0) & (p90 <= 3.6) & (b2 < 0.13) & (c1 < 0.04), "A2")
        .when((avg <= 2.47) & (eff <= 2.58) & (p80 <= 3.5) & (p90 <= 4.1) & (c1 < 0.082), "B1")
        .when(~bridge & ((avg < 2.55) | (p90 < 4.35) | (c1 < 0.095)), "B2")
        .when((eff <= 3.40) & (c1 < 0.25), "C1")
        .otherwise("C2")
    )
