"""Run configuration: one frozen dataclass, buildable from the Y/N style option dictionary."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace

from .schemas import COUNTRIES, CROP_IDS, CROP_NAMES, LEVELS

# Option names whose spelling differs from the field names below.
_OPTION_FIELDS = {
    "season_crosses_calendar_year": "season_crosses_year",
    "compare_with_mcyfs": "compare_with_forecast",
}

# Sources every run reads.
BASE_SOURCES = ("WOFOST", "METEO_DAILY", "SOIL", "YIELD")


@dataclass(frozen=True)
class RunConfig:
    crop_name: str = "potatoes"
    season_crosses_year: bool = False
    country_code: str | None = "NL"
    nuts_level: str = "NUTS2"
    # source -> level; None reads BASE_SOURCES at `nuts_level`
    data_sources: dict | None = None
    use_yield_trend: bool = False
    predict_yield_residuals: bool = False
    find_optimal_trend_window: bool = False
    trend_windows: tuple[int, ...] = (5, 7, 10)
    use_centroids: bool = False
    use_remote_sensing: bool = True
    early_season_prediction: bool = False
    early_season_end_dekad: int = 15
    data_path: str = "."
    output_path: str = "."
    file_format: str = "csv"
    save_features: bool = False
    use_saved_features: bool = False
    save_predictions: bool = True
    use_saved_predictions: bool = False
    compare_with_forecast: bool = False
    # season ends from the first and last year of the whole table instead of each region's own
    global_year_bounds: bool = False
    debug_level: int = 0  # above 0 results carry the row count after each joining step
    # machine learning
    test_fraction: float = 0.3
    cv_folds: int = 5
    parallelism: int = 4
    estimators: tuple = field(default_factory=tuple)  # () = the default set of operators.models
    selectors: tuple[str, ...] = ("random_forest", "rfe_lasso")
    metrics: tuple[str, ...] = ("NMAE", "MAPE", "NRMSE", "R2")
    # what cross-validation minimises: MSE, RMSE, MAE or R2 (as 1 - R²)
    selection_objective: str = "MSE"
    training_objective: str = "MSE"
    scaler: str = "standard"  # or minmax

    def __post_init__(self):
        object.__setattr__(self, "crop_name", self.crop_name.lower())
        object.__setattr__(self, "nuts_level", self.nuts_level.upper())
        object.__setattr__(self, "trend_windows", tuple(self.trend_windows))
        checks = [
            (self.crop_name in CROP_IDS, f"unknown crop {self.crop_name!r}"),
            (self.country_code is None or self.country_code in COUNTRIES
             or len(self.country_code) == 2, f"bad country code {self.country_code!r}"),
            (self.nuts_level in LEVELS, f"unknown level {self.nuts_level!r}"),
            (self.trend_windows and min(self.trend_windows) > 2,
             "trend windows need at least 3 years"),
            (abs(self.early_season_end_dekad) <= 36, "early season offset outside -36..36"),
            (self.file_format in ("csv", "parquet"), "file format must be csv or parquet"),
            (0 < self.test_fraction < 1, "test fraction outside (0, 1)"),
            ({self.selection_objective, self.training_objective} <= {"MSE", "RMSE", "MAE", "R2"},
             "objectives must be MSE, RMSE, MAE or R2"),
            (self.scaler in ("standard", "minmax"), "scaler must be standard or minmax"),
        ]
        for ok, message in checks:
            if not ok:
                raise ValueError(message)

    @property
    def crop_id(self) -> int:
        return CROP_IDS[self.crop_name]

    @property
    def early_offset(self) -> int | None:
        """Early-season end relative to harvest, or None for whole-season features."""
        return self.early_season_end_dekad if self.early_season_prediction else None

    @property
    def sources(self) -> dict[str, str]:
        """Source name -> region level. Remote sensing is kept one level, NUTS2, for all runs."""
        wanted = self.data_sources or BASE_SOURCES
        chosen = dict(wanted) if isinstance(wanted, Mapping) else {
            s: "NUTS2" if s == "REMOTE_SENSING" else self.nuts_level for s in wanted
        }
        for source, wanted, level in (
            ("CENTROIDS", self.use_centroids, self.nuts_level),
            ("REMOTE_SENSING", self.use_remote_sensing, "NUTS2"),
        ):
            if wanted:
                chosen.setdefault(source, level)
            else:
                chosen.pop(source, None)
        return chosen

    def updated(self, **changes) -> RunConfig:
        return replace(self, **changes)

    @classmethod
    def from_options(cls, options: dict) -> RunConfig:
        """Build from an option dictionary whose flags are 'Y' or 'N'."""
        names = {f.name: f.type for f in fields(cls)}
        values = {}
        for key, value in options.items():
            if key == "crop_id":
                key, value = "crop_name", CROP_NAMES[value]
            key = _OPTION_FIELDS.get(key, key)
            if key not in names:
                raise ValueError(f"unknown option {key!r}")
            if names[key] == "bool" and isinstance(value, str):
                if value.upper() not in ("Y", "N"):
                    raise ValueError(f"{key} must be Y or N")
                value = value.upper() == "Y"
            values[key] = tuple(value) if key == "trend_windows" else value
        return cls(**values)
