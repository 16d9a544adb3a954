"""End-to-end composition of the operators (the original ETL, as lazy frames).

Each stage is a property built on first access; nothing runs until an action.
Stages that several later stages read are the same logical plan, so Spark
reuses their shuffle output within one query (``ReusedExchange``) instead of
recomputing it.  ``materialize`` writes a stage as a Parquet table (S5) for
reuse across jobs.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from roadtrace.operators import features as feat
from roadtrace.operators import quality as q
from roadtrace.operators import segments as segm
from roadtrace.operators import trips as tr
from roadtrace.operators.network import Network, synthetic_network
from roadtrace.plans.joins import record_bound
from roadtrace.schema import SIGHTING_COLS
from roadtrace.sources.adapter import load_sightings
from roadtrace.sources.stages import materialize, write_counted

# Cut time used with the synthetic test tables: their per-plate gaps are far
# longer than a real highway's, so the 30-minute cut would end every trip.
TEST_CUT_MINUTES = 720
ALL_POLICIES = (*tr.POLICIES, "none")


class Pipeline:
    """The stages of one input: a test folder (``sf_dir``) or the caller's sightings (``raw``).

    ``materialize_stages`` writes each stage once as Parquet (S5): under the
    cluster's checkpoint folder, or under ``stage_dir`` when the stages are
    results of their own (``plans.analysis``).  ``stage_key`` names the input
    of ``raw``; without one its stages belong to this object alone.
    ``raw_is_set`` says that ``raw`` has no repeated rows; otherwise they are
    removed first, as the ingest does.
    """

    def __init__(self, spark: SparkSession, sf_dir: str | None = None,
                 raw: DataFrame | None = None, network: Network | None = None,
                 policy: str = "as_coded", cut_minutes: int = tr.CUT_MINUTES,
                 hot_threshold: int = tr.HOT_PLATE_ROWS,
                 materialize_stages: bool = False, reuse_existing: bool = False,
                 stage_key: str | None = None, stage_dir: str | None = None,
                 raw_is_set: bool = False):
        if raw is None and sf_dir is None:
            raise ValueError("give sf_dir or raw")
        if reuse_existing and raw is not None and stage_key is None:
            raise ValueError("stages of raw are only reusable under a stage_key")
        self.spark = spark
        self.sf_dir = sf_dir
        self._raw = raw
        self._raw_is_set = raw_is_set
        self._network = network
        self.policy = policy
        self.cut_minutes = cut_minutes
        self.hot_threshold = hot_threshold
        self.materialize_stages = materialize_stages
        self.stage_dir = stage_dir
        self._key = sf_dir or stage_key or uuid.uuid4().hex
        # read completed stages of an earlier application with the same key
        # (the original's "read the stage folder if it exists"), off by default
        self.reuse_existing = reuse_existing

    def _stage(self, name: str, params: tuple, build) -> DataFrame:
        if not self.materialize_stages:
            return build()
        return materialize(self.spark, name, (self._key, *params), build, self.reuse_existing,
                           None if self.stage_dir is None else f"{self.stage_dir.rstrip('/')}/{name}.parquet")

    # ------------------------------------------------------------- cleaning
    @cached_property
    def raw(self) -> DataFrame:
        # S1 + S5: the de-duplicated sightings, written once (the original's raw stage)
        if self._raw is None:
            return self._stage("raw", (), lambda: load_sightings(self.spark, self.sf_dir))
        return self._stage("raw", (), lambda: self._raw if self._raw_is_set else self._raw.distinct())

    @cached_property
    def valid(self) -> DataFrame:
        return q.valid_sightings(self.raw)

    @cached_property
    def conflicts(self) -> DataFrame:
        return self._stage("conflicts", (), lambda: q.spatial_conflicts(self.valid))

    @cached_property
    def clean(self) -> DataFrame:
        # raw is already a set (ingest de-duplicates): no second distinct.
        # With the conflicts stage written, the anti join reads that small
        # table; otherwise the keys come from a cheap min/max aggregate.
        conflicts = self.conflicts if self.materialize_stages else None
        return q.remove_conflicts(self.valid, conflicts, dedupe=False)

    @cached_property
    def multinat(self) -> DataFrame:
        return self._stage("multinat", (), lambda: q.multinat_plates(self.clean))

    @cached_property
    def fixable(self) -> DataFrame:
        return q.fixable_multinat(self.multinat)

    @cached_property
    def fixed(self) -> DataFrame:
        return self._stage("fixed", (), lambda: q.fix_nationality(self.clean, self.fixable))

    @cached_property
    def nonnull(self) -> DataFrame:
        return q.drop_null_rows(self.fixed)

    # --------------------------------------------------------------- network
    @property
    def network(self) -> Network:
        if self._network is None:
            self._network = synthetic_network(self.spark)
        return self._network

    # ----------------------------------------------------------------- trips
    @cached_property
    def _chunks(self) -> DataFrame | None:
        """Where hot plates are cut, found once for every policy (None without hot plates)."""
        return tr.chunk_map(self.nonnull, self.hot_threshold)

    @cached_property
    def windowed(self) -> DataFrame:
        """The sightings in their windows with the splits of every policy: the one
        full-width copy behind all trips and the consecutive pairs."""
        return self._stage("windowed", (self.cut_minutes, self.hot_threshold), lambda: tr.windowed(
            self.nonnull, self.network.pairs, ALL_POLICIES, self.cut_minutes, self._chunks))

    @cached_property
    def _summary(self) -> DataFrame | None:
        if self._chunks is None:
            return None
        s = tr.chunk_summary(self.windowed, self.network.pairs, ALL_POLICIES, self.cut_minutes)
        return record_bound(*write_counted(self.spark, s))

    def trips_for(self, policy: str) -> DataFrame:
        return tr.stitched(self.windowed, self._summary, policy, SIGHTING_COLS)

    @cached_property
    def sequence(self) -> DataFrame:
        """Every sighting with the plate's previous one (W1, F2 and A7 read it)."""
        return self.trips_for("none")

    @cached_property
    def trips(self) -> DataFrame:
        return self.trips_for(self.policy)

    @cached_property
    def segments(self) -> DataFrame:
        return tr.segments(self.trips)

    @cached_property
    def enriched(self) -> DataFrame:
        return segm.enriched_segments(self.segments, self.network.oriented)

    @cached_property
    def trip_stats(self) -> DataFrame:
        return feat.trip_stats(self.enriched)

    # --------------------------------------------------------------- features
    @cached_property
    def global_features(self) -> DataFrame:
        return feat.plate_global_features(self.nonnull, sequence=self.sequence)

    @cached_property
    def trip_summary(self) -> DataFrame:
        return feat.plate_trip_summary(self.trip_stats)

    @cached_property
    def plate_features(self) -> DataFrame:
        """A stage: scaling, the vector fit and the report each read it."""
        return self._stage(f"plate_features_{self.policy}", (self.cut_minutes, self.hot_threshold),
                           lambda: feat.plate_features(self.global_features, self.trip_summary))

    # ------------------------------------------------------------- clustering
    @cached_property
    def vectorized(self) -> DataFrame:
        """M1 + M2 output, a stage (as the original's vectorized table): the
        clustering fits iterate over it many times."""
        from roadtrace.operators.clustering import plate_vectors
        return self._stage(f"vectorized_{self.policy}", (self.cut_minutes, self.hot_threshold),
                           lambda: plate_vectors(self.plate_features))

    # ----------------------------------------------------------------- report
    def quality_report(self) -> dict[str, DataFrame]:
        """The counts that the original prints along its run."""
        return {
            "stage_counts": q.stage_counts({"raw": self.raw, "valid": self.valid, "clean": self.clean,
                                            "fixed": self.fixed, "nonnull": self.nonnull}),
            "unknown_before_after": q.unknown_before_after(self.clean, self.fixed),
            "nationality_counts": q.nationality_counts(self.fixed),
            "multinat_by_num": q.multinat_by_num(self.multinat),
            "multinat_by_set": q.multinat_by_set(self.multinat),
            "conflicts_by_month": q.conflicts_by_month(self.conflicts),
        }
