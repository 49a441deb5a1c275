"""From sparse measures to a ranked risk map."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregate, evaluate, joins


def rank_by_history(
    lattice: DataFrame,
    fact: DataFrame,
    loc: Sequence[str],
    ts: str,
    label: str,
    boundary: str,
    m: float = 200.0,
    by: Sequence[str] = (),
    place: Sequence[str] | None = None,
    digits: int | None = None,
) -> DataFrame:
    """Score cells from ``boundary`` on by the shrunken rate of the earlier ones.

    A rate belongs to ``place`` (by default all of ``loc``), hour and weekday. With ``digits``, scores that agree to so
    many places are ties. Returns n, positives, average precision and lift per ``by``.
    """
    cells = joins.attach_labels(lattice, fact.select(*loc, ts, label), [*loc, ts], [label]).select(
        *loc, ts, label, F.hour(ts).alias("hour"), F.weekday(ts).alias("dow")
    )
    cut = F.lit(boundary).cast("timestamp_ntz")
    keys = [*(loc if place is None else place), "hour", "dow"]
    rates = aggregate.eb_rate(cells.filter(F.col(ts) < cut), keys, label, m)
    scored = aggregate.apply_eb(cells.filter(F.col(ts) >= cut), rates, keys, "score")
    if digits is not None:
        scored = scored.withColumn("score", F.round("score", digits))
    return evaluate.ranking_metrics(scored, label, "score", by)
