"""Monitor a prediction log in one call: log, frozen reference, state table, risk, threshold."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reference as ref
from ..operators import risk as rk
from ..operators import boosting, scorer, targets, windows
from ..operators import state as st
from ..operators.fused import WindowPass, embedding_vectors, frozen_vectors
from ..operators.geometry import fit_geometry, second_moments, window_distances, window_shape
from ..session import freeze
from ..sources.cache import TableCache
from ..sources.stream_log import StreamSpec, numbered_log
from ..sources.tables import table

_BUILT: dict[tuple[str, str, str], "Monitor"] = {}


class Monitor:
    """Tables of one monitored stream family. Each is built on first use and then frozen.

    Row-level tables are written once, partitioned by segment, so a reference fit reads only the
    pre-deployment files. Window-level tables are a factor ``window`` smaller.
    """

    def __init__(self, source: DataFrame, spec: StreamSpec, cache: TableCache | None = None):
        if spec.scorer not in ("rates", "boosted"):
            raise ValueError(f"unknown scorer {spec.scorer!r}; choose from rates, boosted")
        if spec.scorer == "boosted" and not spec.features:
            raise ValueError("a boosted scorer needs features")
        self.source, self.spec, self.cache = source, spec, cache
        self._key = cache.key(source, spec.key()) if cache else ""

    def _kept(self, label: str, make: Callable[[], DataFrame], partition_by: tuple[str, ...] = ()) -> DataFrame:
        """A frozen table: of this session or, with a cache, of any session with the same source."""
        if self.cache:
            return self.cache.table(self._key, label, make, partition_by)
        return freeze(make(), label, partition_by=partition_by)

    # -- row level -------------------------------------------------------------------------
    @cached_property
    def _numbered(self) -> DataFrame:
        return numbered_log(self.source, self.spec)

    @cached_property
    def sizes(self) -> DataFrame:
        return self._kept("sizes", lambda: windows.deployment_sizes(
            self._numbered, self.spec.window, self.spec.pre_fraction))

    def _require_streams(self) -> None:
        """Refuse the log if a stream is too short for one window on either side of deployment."""
        refused = [r["stream_id"] for r in self.sizes.filter("refused").orderBy("stream_id").limit(10).collect()]
        if refused:
            raise ValueError(f"streams without a complete window before and after deployment: {refused}")
        s = self.spec
        if s.given or s.embedding:
            log = self._numbered if s.given else self._numbered.withColumn("y_pred", F.lit(0.0))
            bad = scorer.log_violations(log, s.classes if s.given else 0, bool(s.embedding)).limit(10).collect()
            if bad:
                raise ValueError(f"invalid prediction log: {[r.asDict() for r in bad]}")

    @cached_property
    def _placed(self) -> DataFrame:
        self._require_streams()
        return windows.assign_windows(self._numbered, self.sizes, self.spec.window)

    @cached_property
    def scorer_tables(self) -> tuple[DataFrame, DataFrame]:
        """The frozen rate table by key and by stream, fitted on pre-deployment rows only."""
        def fitted() -> tuple[DataFrame, DataFrame]:
            s, pre = self.spec, self._placed.filter("segment = 'pre'")
            return scorer.fit_class_rates(pre, s.classes, s.members) if s.classes else scorer.fit_means(pre)

        return (self._kept("key-rates", lambda: fitted()[0]), self._kept("stream-rates", lambda: fitted()[1]))

    @cached_property
    def scorer_model(self) -> boosting.Boosted:
        """The frozen boosted trees, fitted on pre-deployment rows of all streams."""
        def fitted() -> boosting.Boosted:
            settings = boosting.Settings(rounds=self.spec.rounds, depth=self.spec.depth)
            return boosting.fit(self._placed.filter("segment = 'pre'"), classes=self.spec.classes, settings=settings)

        if not self.cache:
            return fitted()
        spark = self.source.sparkSession
        path, _ = self.cache.folder(self._key, "scorer-model", lambda path: fitted().save(spark, path))
        return boosting.Boosted.load(spark, path)

    @cached_property
    def target_scale(self) -> DataFrame:
        return self._kept("target-scale", lambda: scorer.target_scale(self._placed.filter("segment = 'pre'")))

    def scored(self, rows: DataFrame) -> DataFrame:
        """Predictions and loss of any rows with stream_id, score_key and y (batch or streaming);
        for a given log, of rows that carry its predictions."""
        s = self.spec
        if s.given:
            return (scorer.given_classes(rows) if s.classes
                    else scorer.given_values(rows, self.target_scale))
        if s.scorer == "boosted":
            out = boosting.score(rows, self.scorer_model, members=s.members)
            return (scorer.given_classes(out) if s.classes
                    else scorer.given_values(out, self.target_scale))
        if s.classes:
            return scorer.score_classes(rows, *self.scorer_tables, s.members)
        return scorer.score_means(rows, *self.scorer_tables)

    @cached_property
    def rows(self) -> DataFrame:
        return self._kept("scored", lambda: self.scored(self._placed).drop(
            "n_rows", "n_pre_windows", "n_windows", "refused"), ("segment",))

    @property
    def pre(self) -> DataFrame:
        return self.rows.filter("segment = 'pre'")

    @property
    def deployment(self) -> DataFrame:
        """Deployment rows that belong to a complete window."""
        return self.rows.filter("segment = 'dep' and window_idx is not null")

    # -- window level ----------------------------------------------------------------------
    @cached_property
    def all_risk(self) -> DataFrame:
        regime = [F.min_by("regime", "seg_row").alias("regime")] if self.spec.regime else []
        return self._kept("risk", lambda: self.rows.filter("window_idx is not null").groupBy(
            "segment", "stream_id", "window_idx").agg(
                rk.window_risk(F.col("loss")).alias("risk"), F.min("ts").alias("t_start"),
                F.max("ts").alias("t_stop"), *regime), ("segment",))

    @property
    def risk(self) -> DataFrame:
        return self.all_risk.filter("segment = 'dep'").drop("segment")

    @property
    def pre_risk(self) -> DataFrame:
        return self.all_risk.filter("segment = 'pre'").drop("segment")

    # -- frozen reference ------------------------------------------------------------------
    @cached_property
    def reference_risk(self) -> DataFrame:
        return self._kept("reference-risk", lambda: rk.reference_risk(self.pre_risk))

    @cached_property
    def eps(self) -> DataFrame:
        return rk.threshold(self.reference_risk, self.spec.quantile, self.spec.margin)

    @cached_property
    def reference_features(self) -> DataFrame:
        return self._kept("reference-features", lambda: ref.feature_reference(
            self.pre, len(self.spec.features)))

    @cached_property
    def reference_behaviour(self) -> DataFrame:
        return self._kept("reference-behaviour", lambda: ref.behaviour_reference(
            self.pre, self.spec.classes))

    @cached_property
    def reference_sample(self) -> DataFrame:
        return self._kept("reference-sample", lambda: ref.reference_sample(
            self.pre, self.spec.sample_rows))

    @cached_property
    def geometry(self) -> DataFrame:
        width = len(self.spec.features)
        return self._kept("reference-geometry", lambda: fit_geometry(
            self.reference_sample, self.reference_features, self.pre, width,
            min(ref.COMPONENTS, width)))

    # -- state blocks ----------------------------------------------------------------------
    @cached_property
    def scales(self) -> DataFrame:
        return self._kept("scales", lambda: ref.scale_vectors(self.reference_features))

    @cached_property
    def _pass(self) -> WindowPass:
        width = 0
        if self.spec.embedding or self.spec.scorer == "boosted":
            width = self.embedding_reference.agg(F.max("feature")).first()[0] + 1
        window = 0 if self.spec.given or self.spec.embedding else self.spec.window
        return WindowPass(self.spec.classes, len(self.spec.features), width, window)

    @cached_property
    def _frozen(self) -> DataFrame | None:
        n = len(self.spec.features)
        return self._kept("frozen-vectors", lambda: frozen_vectors(self.reference_features, n)) if n else None

    @cached_property
    def windows(self) -> DataFrame:
        """What the row-level blocks need of each window: one scan of the deployment rows, one shuffle."""
        return self._kept("windows", lambda: self._pass.run(self.deployment, self._frozen))

    @cached_property
    def row_blocks(self) -> DataFrame:
        """Columns of the row-level blocks, without distances from the sample and the cloud's shape."""
        s = self.spec
        behaviour = self.reference_behaviour if s.classes else None
        vectors = embedding_vectors(self.embedding_reference) if s.features or s.embedding else None
        return self._kept("row-blocks", lambda: self._pass.blocks(self.windows, behaviour, self._frozen, vectors))

    @cached_property
    def shape_block(self) -> DataFrame:
        """The cloud's covariance shape and principal coordinates: sums of each window's rows alone."""
        n = len(self.spec.features)

        def made() -> DataFrame:
            rows = ref.standardise(self.deployment.select(*st.KEY, "x"), self.scales)
            return window_shape(second_moments(rows, st.KEY, n), self.geometry, n, min(ref.COMPONENTS, n))

        return self._kept("shape-block", made)

    @cached_property
    def distance_block(self) -> DataFrame:
        """Distances of each window's rows from the reference sample."""
        return self._kept("distance-block", lambda: window_distances(
            self.windows, self.reference_sample, self.reference_features, self.geometry, self.sizes,
            len(self.spec.features)))

    @property
    def geometry_block(self) -> DataFrame:
        return self.shape_block.join(self.distance_block, st.KEY, "left")

    def embedded(self, rows: DataFrame) -> DataFrame:
        """Rows with ``z``: the logged embedding, the scorer's own, or inputs in frozen reference units."""
        if self.spec.embedding or self.spec.scorer == "boosted":
            return rows.withColumn("z", F.col("embedding"))
        return ref.standardise(rows, self.scales)

    @cached_property
    def embedding_reference(self) -> DataFrame:
        return self._kept("embedding-reference", lambda: st.embedding_reference(self.embedded(self.pre)))

    def blocks(self, interventions: DataFrame | None = None) -> dict[str, DataFrame]:
        """The state blocks this stream supports, keyed by prefix; feature blocks need inputs."""
        s, rows = self.spec, self.row_blocks

        def own(prefix: str) -> DataFrame:
            return rows.select(*st.KEY, *[c for c in rows.columns if c.startswith(f"{prefix}_")])

        out = {"pred": own("pred"), "unc": own("unc")}
        if s.embedding or s.features:
            out["rep"] = own("rep")
        if s.features:
            cols = self.geometry_block.columns
            for b in ("rep", "dist"):
                out[b] = own(b).join(self.geometry_block.select(
                    *st.KEY, *[c for c in cols if c.startswith(f"{b}_")]), st.KEY)
        ece = rows.select(*st.KEY, "ece") if s.classes else None
        out["fb"] = st.feedback_block(self.risk, self.reference_risk, s.delay, ece=ece)
        out["ctx"] = st.context_block(self.risk, "regime" if s.regime else None)
        out["adapt"] = st.adaptation_block(self.risk, interventions)
        return out

    def state(self, blocks: tuple[str, ...] = st.BLOCKS,
              interventions: DataFrame | None = None) -> DataFrame:
        """State table: one row per deployment window, features in sorted order."""
        made = self.blocks(interventions)
        unknown = set(blocks) - set(st.BLOCKS)
        if unknown:
            raise ValueError(f"unknown state blocks {sorted(unknown)}")
        chosen = {b: made[b] for b in blocks if b in made}
        if not chosen:
            raise ValueError("no state block was chosen")
        # Blocks of one table are taken from it together, not joined with each other.
        late = ("fb", "ctx", "adapt")
        of_rows = tuple(f"{b}_" for b in chosen if b not in late)
        parts = [made[b] for b in chosen if b in late]
        if of_rows:
            shared = [self.row_blocks] + ([self.shape_block] if "rep_" in of_rows and self.spec.features else []) + (
                [self.distance_block] if {"rep_", "dist_"} & set(of_rows) and self.spec.features else [])
            parts = [t.select(*st.KEY, *[c for c in t.columns if c.startswith(of_rows)]) for t in shared] + parts
        base = st.assemble(parts)
        heads = {"pred": "pred_msp_mean" if self.spec.classes else "pred_mean",
                 "rep": "rep_centroid_shift", "dist": "dist_mmd2",
                 "unc": "unc_entropy_mean" if self.spec.classes else "unc_pred_var"}
        wanted = {f"{b}_volatility": c for b, c in heads.items() if b in chosen}
        if not wanted:
            return base
        trend = {"dist_trend": "dist_mmd2"} if "dist" in chosen else None
        # The volatility features look back over the base table, which is frozen first so that the
        # blocks are not computed twice.
        base = freeze(base, "state-base")
        return st.assemble([base, st.volatility(base, wanted, trend)])

    @cached_property
    def states(self) -> DataFrame:
        return self._kept("states", self.state)

    # -- targets ---------------------------------------------------------------------------
    @cached_property
    def origins(self) -> DataFrame:
        """Censored targets with history and anchor; one row per valid origin."""
        s = self.spec
        return self._kept("origins", lambda: targets.with_history(
            targets.censored_targets(self.risk, self.eps, s.horizon), self.risk, s.context, s.delay))


def monitor(spark: SparkSession, folder: str, spec: StreamSpec) -> Monitor:
    """Monitor a stored table; the same table and parameters share one set of frozen tables.

    With the session's setting ``spark.stillvalid.cache.dir`` they are shared by all sessions.
    """
    at = (spark.sparkContext.applicationId, folder, spec.key())
    if at not in _BUILT:
        root = spark.conf.get("spark.stillvalid.cache.dir", None)
        _BUILT[at] = Monitor(table(spark, folder, spec.table), spec, TableCache(spark, root) if root else None)
    return _BUILT[at]
