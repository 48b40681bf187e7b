"""Features as declared lists: what training and scoring share.

A feature names its column, what fills its gaps (a constant, another column, or
the median of the training rows), bounds, and whether its logarithm is taken.
`learn` gets the medians of a training table by one exact pass; the result
builds the same columns from any table, as expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import medians

MEDIAN = "median"


@dataclass(frozen=True)
class Feature:
    """fill: MEDIAN, a number, or the name of another column (or feature before it), whose gaps are then filled by the median. median: learned."""

    name: str
    source: str
    fill: float | str = MEDIAN
    low: float | None = None
    high: float | None = None
    log1p: bool = False
    median: float | None = None

    def column(self, before: dict[str, Column]) -> Column:
        """Filled, bounded, then logged; NaN is a gap."""
        number = lambda c: F.when(~F.isnan(c.cast("double")), c.cast("double"))
        x = number(F.col(self.source))
        if isinstance(self.fill, str) and self.fill != MEDIAN:
            x = F.coalesce(x, before.get(self.fill, number(F.col(self.fill))))
        elif not isinstance(self.fill, str):
            x = F.coalesce(x, F.lit(float(self.fill)))
        if self.median is not None:
            x = F.coalesce(x, F.lit(self.median))
        if self.low is not None:
            x = F.when(x.isNotNull(), F.greatest(x, F.lit(float(self.low))))
        if self.high is not None:
            x = F.when(x.isNotNull(), F.least(x, F.lit(float(self.high))))
        return F.log1p(x) if self.log1p else x


@dataclass(frozen=True)
class FeatureSet:
    """Features in order; a target is the reference less the raw value, and training rows have both."""

    features: tuple[Feature, ...]
    raw: str
    reference: str

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.features]

    def columns(self) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for f in self.features:
            out[f.name] = f.column(out)
        return out

    def learn(self, training: DataFrame) -> FeatureSet:
        """With the medians of the sources over all rows that have a target, before bounds and logarithms; a source without values gets 0."""
        sources = sorted({f.source for f in self.features if isinstance(f.fill, str)})
        if not sources:
            return self
        each = F.explode(F.array(*[F.struct(F.lit(s).alias("_source"), F.col(s).cast("double").alias("_x")) for s in sources])).alias("e")
        values = self._with_target(training).select(each).select("e.*").where(~F.isnan("_x"))
        learned = {r["_source"]: r["median"] for r in medians(values, ["_source"], "_x").collect()}  # a row for each source
        return replace(self, features=tuple(replace(f, median=float(learned.get(f.source, 0.0))) if isinstance(f.fill, str) else f for f in self.features))

    def _with_target(self, df: DataFrame) -> DataFrame:
        number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        return df.withColumn("_y", number(self.reference) - number(self.raw)).where(F.col("_y").isNotNull())

    def training(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """keep, the features and y, of the rows that have a target."""
        return self._with_target(df).select(*keep, *[c.alias(n) for n, c in self.columns().items()], F.col("_y").alias("y"))

    def scoring(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """keep and the features, of all rows."""
        return df.select(*keep, *[c.alias(n) for n, c in self.columns().items()])
