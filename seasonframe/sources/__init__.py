from .readers import load_all, read_levels, read_source, source_path
from .writers import (
    load_features, load_predictions, output_name, save_features, save_national_predictions,
    save_predictions,
)

__all__ = [
    "load_all", "read_levels", "read_source", "source_path",
    "load_features", "load_predictions", "output_name", "save_features",
    "save_national_predictions", "save_predictions",
]
