"""Vertex programs: what a vertex sends, how messages are combined, and what it makes of them.

A program is a set of Column builders, so a superstep stays one Catalyst plan:
a join along the edges, a sum per receiver, and a projection.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

RESET, LOWEST, HIGHEST = 0.15, 0.15, 500.0


def clamped(x: Column, low: float, high: float) -> Column:
    """Into [low, high]; NaN passes, as comparisons with it fail."""
    return F.when(F.isnan(x), x).when(x > high, F.lit(high)).when(x < low, F.lit(low)).otherwise(x)


def relative_change(new: Column, old: Column) -> Column:
    """|new - old| / |old|; infinite for an old value of 0, NaN if nothing changed from 0."""
    zero = F.when(new == old, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    return F.when(old == 0, zero).otherwise(F.abs((new - old) / F.when(old == 0, F.lit(1.0)).otherwise(old)))


def guarded_change(new: Column, old: Column) -> Column:
    """Divided by the old value only where that is over 1e-5."""
    return F.abs(new - old) / F.when(F.abs(old) > 1e-5, F.abs(old)).otherwise(F.lit(1.0))


def change_from(new: Column, old: Column) -> Column:
    """An old value of 0 is taken as 1e-6, above and below the line."""
    base = F.when(old != 0, old).otherwise(F.lit(1e-6))
    return F.abs((new - base) / base)


@dataclass(frozen=True)
class VertexProgram:
    """state: columns at the start, by vertex columns.  forward and backward: the message along an edge (to dst) and against it (to src),
    from the sender's state and ``out_degree``/``in_degree``.  apply: new columns from the sums ``_f``, ``_b`` and the old state."""

    state: dict[str, Callable[[], Column]]
    apply: Callable[[], dict[str, Column]]
    forward: Callable[[], Column] | None = None
    backward: Callable[[], Column] | None = None


def pagerank() -> VertexProgram:
    def apply() -> dict[str, Column]:
        new = clamped(F.lit(RESET) + F.lit(1 - RESET) * F.col("_f"), LOWEST, HIGHEST)
        return {"rank": new, "last_change": relative_change(new, F.col("rank"))}

    return VertexProgram({"rank": lambda: F.lit(1.0), "last_change": lambda: F.lit(0.0)}, apply, forward=lambda: F.col("rank") / F.col("out_degree"))


def personalized_pagerank() -> VertexProgram:
    def apply() -> dict[str, Column]:
        new = clamped(F.when(F.col("is_seed"), F.lit(RESET)).otherwise(F.lit(0.0)) + F.lit(1 - RESET) * F.col("_f"), 0.0, HIGHEST)
        return {"rank": new, "last_change": guarded_change(new, F.col("rank"))}

    start = {"rank": lambda: F.when(F.col("is_seed"), F.lit(1.0)).otherwise(F.lit(0.0)), "last_change": lambda: F.lit(0.0)}
    return VertexProgram(start, apply, forward=lambda: F.col("rank") / F.col("out_degree"))


def hits(change_mode: str = "consistent") -> VertexProgram:
    """``change_mode="reference"`` compares each new value with the old one of the other kind."""

    def apply() -> dict[str, Column]:
        a, h = F.col("_f"), F.col("_b")
        old_a, old_h = F.col("authority"), F.col("hub")
        changes = (change_from(h, old_a), change_from(a, old_h)) if change_mode == "reference" else (change_from(a, old_a), change_from(h, old_h))
        return {"authority": a, "hub": h, "last_change_a": changes[0], "last_change_h": changes[1]}

    return VertexProgram(two_sided(), apply, forward=lambda: F.col("hub"), backward=lambda: F.col("authority"))


def salsa() -> VertexProgram:
    def apply() -> dict[str, Column]:
        a, h = F.col("_f"), F.col("_b")
        return {"authority": a, "hub": h, "last_change_a": change_from(a, F.col("authority")), "last_change_h": change_from(h, F.col("hub"))}

    return VertexProgram(two_sided(), apply, forward=lambda: F.col("hub") / F.col("out_degree"), backward=lambda: F.col("authority") / F.col("in_degree"))


def two_sided() -> dict[str, Callable[[], Column]]:
    return {"authority": lambda: F.lit(1.0), "hub": lambda: F.lit(1.0), "last_change_a": lambda: F.lit(0.0), "last_change_h": lambda: F.lit(0.0)}


PROGRAMS = {"pagerank": pagerank, "personalpagerank": personalized_pagerank, "hits": hits, "salsa": salsa}
