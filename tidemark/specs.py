"""Declared datasets: schema, keys, required columns, date column and least number of rows.

A loader, a readiness check and a table definition all read the same spec.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

PROVENANCE = (T.StructField("source", T.StringType()), T.StructField("ingested_at", T.TimestampType()))


@dataclass(frozen=True)
class DatasetSpec:
    """``columns`` maps names to Spark SQL types; ``required`` defaults to all of them."""

    name: str
    columns: dict[str, str]
    keys: tuple[str, ...]
    required: frozenset[str] | None = None
    date_column: str | None = None
    minimum_rows: int = 0
    full_window: bool = True
    provenance: bool = field(default=True)

    @property
    def needed(self) -> frozenset[str]:
        return frozenset(self.columns) if self.required is None else self.required

    @property
    def schema(self) -> T.StructType:
        fields = [T.StructField(c, T.DataType.fromDDL(t), c not in self.keys) for c, t in self.columns.items()]
        return T.StructType(fields + list(PROVENANCE) * self.provenance)

    @property
    def numeric(self) -> list[str]:
        return [c for c, t in self.columns.items() if t in ("int", "bigint", "smallint", "double")]


def _doubles(names: str) -> dict[str, str]:
    return {c: "double" for c in names.split()}


# Table layouts that users' data already has.
SPECS: dict[str, DatasetSpec] = {
    s.name: s
    for s in (
        DatasetSpec("pitcher_games", {"pitcher_id": "int", "game_id": "string", "game_date": "date", "opponent_team": "string"} | _doubles("earned_runs runs_allowed hits walks strikeouts innings_pitched"), ("pitcher_id", "game_id"), date_column="game_date", minimum_rows=10_000),
        DatasetSpec("pitcher_innings", {"pitcher_id": "int", "game_id": "string", "game_date": "date", "inning": "smallint"} | _doubles("first_inning_runs first_inning_hits first_inning_walks first_inning_strikeouts first_inning_pa"), ("pitcher_id", "game_id", "inning"), frozenset("pitcher_id game_id game_date inning first_inning_runs first_inning_hits first_inning_walks".split()), "game_date", 10_000),
        DatasetSpec("statcast_daily", {"pitcher_id": "int", "game_date": "date"} | _doubles("exit_velocity_sum barrels hard_hits whiffs swings batted_balls"), ("pitcher_id", "game_date"), date_column="game_date", minimum_rows=10_000),
        DatasetSpec("team_games", {"team": "string", "game_id": "string", "game_date": "date"} | _doubles("runs hits at_bats total_bases times_on_base plate_appearances woba_num woba_den"), ("team", "game_id"), date_column="game_date", minimum_rows=10_000),
        DatasetSpec("team_innings", {"team": "string", "game_id": "string", "game_date": "date", "inning": "smallint", "first_inning_runs": "double"}, ("team", "game_id", "inning"), date_column="game_date", minimum_rows=10_000),
        DatasetSpec("batter_games", {"batter_id": "int", "game_id": "string", "game_date": "date"} | _doubles("woba_num woba_den times_on_base plate_appearances"), ("batter_id", "game_id"), date_column="game_date", minimum_rows=50_000),
        DatasetSpec("venue_factors", {"venue_id": "int", "runs_factor": "double", "hr_factor": "double", "hits_factor": "double", "calculated_through": "date"}, ("venue_id",), date_column="calculated_through", minimum_rows=20, full_window=False),
        DatasetSpec("outcomes", {"game_id": "string", "game_date": "date", "away_team": "string", "home_team": "string", "away_sp_id": "int", "home_sp_id": "int", "venue_id": "int", "fi_runs_top": "int", "fi_runs_bottom": "int", "yrfi": "boolean"}, ("game_id",), date_column="game_date", minimum_rows=5_000),
        DatasetSpec("quotes", {"snapshot_id": "string", "fixture_id": "string", "home_team": "string", "away_team": "string", "book": "string", "line": "decimal(3,1)", "over_american": "double", "under_american": "double", "prob_novig": "double", "captured_at": "timestamp"}, ("snapshot_id",)),
        DatasetSpec("feature_store", {"game_id": "string", "feature_version": "string", "game_date": "date", "f": "string", "missing_count": "int", "coverage": "double", "as_of": "timestamp"}, ("game_id", "feature_version")),
        DatasetSpec("registry", {"model_version": "string", "status": "string", "trained_at": "timestamp", "gates_passed": "boolean", "holdout_passed": "boolean", "holdout_burned_rerun": "boolean", "gate_report": "string"}, ("model_version",), provenance=False),
        DatasetSpec("predictions", {"game_id": "string", "model_version": "string", "predicted_at": "timestamp", "p_cal": "double", "p_final": "double", "p_market": "double", "edge": "double", "tier": "string", "status": "string", "reason": "string", "coverage": "double"}, ("game_id", "model_version", "predicted_at"), provenance=False),
        DatasetSpec("grades", {"game_id": "string", "model_version": "string", "p": "double", "y": "int", "brier": "double", "log_loss": "double", "clv": "double", "graded_at": "timestamp"}, ("game_id", "model_version"), provenance=False),
    )
}


def create_table(spark, spec: DatasetSpec, table: str) -> None:
    """Create ``table`` if it is absent."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spec.schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet")


def conform(df, spec: DatasetSpec):
    """``df`` with the spec's columns and types; columns that were added since are null."""
    empty = df.sparkSession.createDataFrame([], T.StructType([T.StructField(f.name, f.dataType) for f in spec.schema.fields]))
    return empty.unionByName(df.select(*[df[c].cast(spec.schema[c].dataType).alias(c) for c in df.columns if c in spec.schema.names]), allowMissingColumns=True)
