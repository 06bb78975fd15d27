"""The two contests: risk-path forecasts and survival ranking, on one leakage-safe split."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import compare as cmp
from ..operators import forecast as fc
from ..operators import learned, metrics, splits, survival
from ..session import freeze
from .monitor import Monitor

_CONTESTS: dict[tuple[int, int], "Contest"] = {}


@dataclass
class Contest:
    """Shared tables of both contests. ``gap`` defaults to the horizon."""

    monitor: Monitor
    gap: int | None = None
    train: float = 0.5
    cal: float = 0.2

    @cached_property
    def split(self) -> DataFrame:
        m = self.monitor
        gap = m.spec.horizon if self.gap is None else self.gap
        return freeze(splits.chronological_split(m.origins, self.train, self.cal, gap), "split",
                      partition_by=("split",))

    def part(self, name: str) -> DataFrame:
        return self.split.filter(F.col("split") == name)

    # -- risk paths ------------------------------------------------------------------------
    @cached_property
    def tuned(self) -> DataFrame:
        return freeze(fc.tune(self.part("calibration")), "tuned")

    @cached_property
    def forecasts(self) -> DataFrame:
        """Tuned forecasts of the test origins, one row per origin and method."""
        return freeze(fc.forecast_lines(self.part("test"), self.tuned), "forecasts")

    def path_scores(self, reference: str = "persistence") -> DataFrame:
        return fc.skill(fc.horizon_scores(self.forecasts, self.monitor.spec.horizon), reference)

    def error_pairs(self, method: str, horizons=(1, 5, 10)) -> DataFrame:
        """Paired test errors of one method and every other at the decision horizons."""
        f = self.forecasts
        listed = F.array(*[F.struct(F.lit(h).alias("h"), F.abs(
            F.get("pred", F.lit(h - 1)) - F.get("target", F.lit(h - 1))).alias("error"))
            for h in horizons])
        errors = f.select("stream_id", "origin", "method", F.inline(listed)).filter(
            "error is not null")
        mine = errors.filter(F.col("method") == method).select(
            "stream_id", "origin", "h", F.col("error").alias("a"))
        other = errors.filter(F.col("method") != method).select(
            "stream_id", "origin", "h", F.col("method").alias("baseline"),
            F.col("error").alias("b"))
        return mine.join(other, ["stream_id", "origin", "h"])

    # -- survival --------------------------------------------------------------------------
    def with_age(self, origins: DataFrame) -> DataFrame:
        return origins.withColumn("age", F.col("origin").cast("bigint"))

    @cached_property
    def reference_curves(self) -> DataFrame:
        """Marginal and age-stratified Kaplan-Meier curves of the test origins."""
        h = self.monitor.spec.horizon
        train, test = self.with_age(self.part("train")), self.with_age(self.part("test"))
        km = survival.apply_curve(test, survival.kaplan_meier(train, h), "kaplan_meier")
        aged = survival.age_kaplan_meier(train, test, h, "age").drop("age_bin")
        return freeze(km.unionByName(aged), "reference-curves")

    def cox_curves(self, columns: list[str], components: int = 8) -> DataFrame:
        """Cox model on principal scores of the latest state, with ``status`` and ``reason``.

        Without a usable estimate the test origins get the marginal curve, the status ``estimation_failed``
        and the method ``cox_failed``, so that no score of the marginal curve counts as one of Cox.
        """
        m = self.monitor
        key = ["stream_id", "origin"]
        states = freeze(m.states.select("stream_id", F.col("window_idx").alias("origin"),
                                        F.array(*columns).alias("state")), "state-vectors")
        base = [*key, "y_tilde", "event"]
        train = self.part("train").select(*base).join(states, key)
        test = self.part("test").select(*base).join(states, key)
        try:
            if not train.head(1):
                raise survival.EstimationFailed("no training origin")
            ztrain, ztest, names = learned.reduce_states(train, test, "state",
                                                         min(components, len(columns)))
            beta, base = survival.cox_fit(ztrain, names, m.spec.horizon)
        except survival.EstimationFailed as e:
            marginal = survival.kaplan_meier(train, m.spec.horizon)
            return survival.apply_curve(test.drop("state"), marginal, "cox_failed").withColumns(
                {"status": F.lit("estimation_failed"), "reason": F.lit(str(e))})
        return survival.cox_predict(ztest, names, beta, base).withColumns(
            {"status": F.lit("ok"), "reason": F.lit(None).cast("string")})

    def survival_scores(self, curves: DataFrame) -> DataFrame:
        """Concordance, integrated Brier score and D-calibration per method."""
        test, h = self.part("test"), self.monitor.spec.horizon
        ibs = metrics.integrated_brier(metrics.brier_by_horizon(curves, test, h))
        return metrics.concordance(curves).join(ibs, "method").join(
            metrics.d_calibration(curves), "method")

    def contribution_pairs(self, curves: DataFrame, method: str) -> DataFrame:
        parts = metrics.concordance_contributions(curves).filter("contribution is not null")
        # Lower must be better for the paired tests, so shares of wrongly ordered pairs are used.
        return cmp.pair_methods(parts.withColumn("loss", 1.0 - F.col("contribution")), method,
                                "loss")


def contest(m: Monitor, gap: int | None = None) -> Contest:
    at = (id(m), -1 if gap is None else gap)
    if at not in _CONTESTS:
        _CONTESTS[at] = Contest(m, gap)
    return _CONTESTS[at]
