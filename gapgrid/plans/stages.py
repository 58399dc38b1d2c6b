"""The whole analysis as named stages, each computed once and kept as a table.

Phases meet at written tables, so a later operator starts from a stage instead of repeating the phases before.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapgrid.functions import scalars as S
from gapgrid.models import validation as V
from gapgrid.operators import cleaning, evaluation, network, profiles, users, zones
from gapgrid.operators.geometry import StudyArea
from gapgrid.params import Params
from gapgrid.plans import views
from gapgrid.session import materialize
from gapgrid.sources.tables import population_cells


class Stages:
    """Trips, population points and polylines in; zone, model and gap tables out.

    The expected demand comes from the technique that the selection rule chooses among the seven, or from ``technique``.
    """

    def __init__(self, trips: DataFrame, points: DataFrame, shapes: DataFrame, p: Params, technique: str | None = None):
        self.trips, self.points, self.shapes, self.p, self._technique = trips, points, shapes, p, technique

    @property
    def technique(self) -> str:
        return self._technique or self.selection[0]

    # ---- cleaning
    @cached_property
    def signals(self) -> DataFrame:
        return materialize(users.signals_of_trips(self.trips, self.p), "signals")

    @cached_property
    def anomalous(self) -> DataFrame:
        return users.anomalous_users(self.signals)

    @cached_property
    def origins(self) -> DataFrame:
        return materialize(cleaning.valid_origins(self.trips, self.anomalous, self.p), "origins")

    @cached_property
    def _area(self):
        return cleaning.study_area(self.origins, self.p, self.p.component_k)

    @property
    def area(self) -> StudyArea:
        return self._area[0]

    @property
    def main_cells(self) -> DataFrame:
        return self._area[1]

    @cached_property
    def steps(self) -> DataFrame:
        return materialize(cleaning.assign_steps(self.trips, self.area, self.anomalous, self.p), "steps")

    @cached_property
    def clean(self) -> DataFrame:
        return materialize(cleaning.clean_trips(self.steps, self.p), "clean")

    @cached_property
    def weeks(self) -> DataFrame:
        return materialize(profiles.weekly_coverage(self.clean), "weeks")

    @cached_property
    def gap(self):
        """(start, end) of the gap: two dates."""
        r = profiles.gap_bounds(self.weeks).first()
        return r.gap_start, r.gap_end

    @cached_property
    def observed_weeks(self) -> float:
        return profiles.observed_weeks(self.weeks).first()[0]

    # ---- zones
    @cached_property
    def population(self) -> DataFrame:
        return materialize(population_cells(self.points, self.p), "population")

    @cached_property
    def zones(self) -> DataFrame:
        z = zones.zone_table(self.clean, self.population, self.area, self.p)
        per = zones.period_counts(self.clean, *self.gap)
        return materialize(zones.join_left_fill(z, per, "cell", {"query_count_before_gap": 0, "query_count_after_gap": 0}), "zones")

    @cached_property
    def modal(self) -> DataFrame:
        return materialize(zones.modal_label(self.clean), "modal")

    @cached_property
    def network(self) -> DataFrame:
        return materialize(network.network_points(self.shapes, self.p), "network")

    @cached_property
    def featured(self) -> DataFrame:
        f = zones.zone_features(self.zones, self.population, self.p)
        x, y = network.project_xy("lat", "lon", self.p)
        f = materialize(f, "features")
        d = network.nearest_distance(f.select("cell", x.alias("x"), y.alias("y")), self.network, "cell")
        f = f.join(d, "cell").withColumn("covered", S.coverage_flag("distance", self.p.coverage_m)).withColumn(
            "dist_network_m", F.round("distance", 1)).drop("distance")
        f = zones.zone_municipality(f, self.modal, self.p).withColumn("in_model", S.in_model_flag(self.p))
        return materialize(f, "featured")

    @cached_property
    def ringed(self) -> DataFrame:
        return zones.distance_rings(self.featured, self.p)[0]

    @cached_property
    def table(self) -> DataFrame:
        return materialize(zones.modelling_table(zones.holdout_split(self.ringed, self.p)), "model-table")

    # ---- models
    @cached_property
    def train(self) -> DataFrame:
        return materialize(V.block_folds(self.table.where("in_model AND NOT in_test"), self.p.folds), "train")

    @property
    def test(self) -> DataFrame:
        return self.table.where("in_model AND in_test")

    @cached_property
    def oof(self) -> DataFrame:
        return materialize(V.cross_validate(self.train, ["B0", "B1", "B2", "B3"], p=self.p), "oof")

    @cached_property
    def oof_all(self) -> DataFrame:
        """Rate techniques and both count regressions."""
        return materialize(self.oof.unionByName(V.cross_validate(self.train, ["M1", "M2"], p=self.p)), "oof-all")

    @cached_property
    def oof_ladder(self) -> DataFrame:
        """All seven techniques, boosting with its whole search."""
        return materialize(self.oof_all.unionByName(V.cross_validate(self.train, ["M3"], p=self.p)), "oof-ladder")

    @cached_property
    def selection(self):
        """(chosen technique, the rule's table)."""
        return V.select_technique(self.oof_ladder, self.p)

    @cached_property
    def gap_zones(self) -> DataFrame:
        model = self.table.where("in_model")
        e = V.expected_by_zone(self.train, self.test, self.technique, p=self.p)
        g = V.expected_by_zone(self.train, self.test, "B0", p=self.p)
        return materialize(evaluation.gap_table(model, e, g, self.observed_weeks, self.p), "gap")

    @cached_property
    def predictions(self) -> DataFrame:
        return materialize(evaluation.zone_predictions(evaluation.prioritise(self.gap_zones, self.p), self.observed_weeks), "predictions")


_OPEN: dict[tuple[str, str], Stages] = {}


def stages_for(spark: SparkSession, sf_dir: str) -> Stages:
    """Stages over the stand-in views of one data folder, shared by the queries of a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        _OPEN[key] = Stages(views.trips(spark, sf_dir), views.population_points(spark, sf_dir), views.shapes(spark, sf_dir),
                            views.FIXTURE_PARAMS, technique="B2")  # the technique that the SQL follows; see ``selected_gap_table``
    return _OPEN[key]
