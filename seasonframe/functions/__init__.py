from .codes import country_of, crop_id, crop_name, parent_region
from .dates import day_of, dekad_of, month_of, parse_date, with_year_dekad, year_of
from .numbers import steady_round, steady_sql

__all__ = [
    "country_of", "crop_id", "crop_name", "parent_region",
    "day_of", "dekad_of", "month_of", "parse_date", "with_year_dekad", "year_of",
    "steady_round", "steady_sql",
]
