"""Readers, writers and model storage."""

from coppice.sources.models import Bundle, load_bundle, load_forests, save_bundle, save_forests
from coppice.sources.tables import normalise_names, read_delimited, write_curves, write_predictions

__all__ = [
    "Bundle",
    "load_bundle",
    "load_forests",
    "normalise_names",
    "read_delimited",
    "save_bundle",
    "save_forests",
    "write_curves",
    "write_predictions",
]
