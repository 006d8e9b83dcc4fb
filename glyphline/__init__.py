"""Symbolic time-series analytics on Spark DataFrames."""

from __future__ import annotations

import importlib

#: Names of the package and where they are; a module is imported when one is asked for, so tasks load what they use.
_PLACES = {
    "plans.encoder": ("SymbolicEncoder", "EncoderModel", "TensorCode", "compress_tensor", "decompress_tensor", "encode_one"),
    "operators.compress": ("compress", "scaled_points", "auto_alpha"),
    "operators.chords": ("compress_ranges",),
    "operators.aggregate": ("greedy", "two_stage", "grid_components", "greedy_1d", "summary"),
    "operators.symbols": ("nearest", "quantize", "ramps", "alphabet"),
    "operators.measures": ("dtw_pairs", "dtw_paths", "boundary_extra", "boundary_report"),
    "operators.prepare": ("fill_missing", "z_normalize", "split_interval", "split_even"),
    "functions.scans": ("scanned", "medians"),
    "functions.ordering": ("with_index",),
}
_HOME = {name: module for module, names in _PLACES.items() for name in names}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(f".{_HOME[name]}", __name__), name)
