"""Season-aligned regional time series on PySpark: cleaning, crop calendars, period
features, yield trends, model selection and area-weighted roll-ups as DataFrame operators."""

from .config import RunConfig

__all__ = ["RunConfig"]
