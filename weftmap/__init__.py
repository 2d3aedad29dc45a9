"""Sparse interaction matrices and training-data operators on Spark. Names are imported when they are first used, so that workers load what they need."""

from importlib import import_module

_HOMES = {
    "functions.bins": ("binnify", "binsize_of", "chromsizes_of", "restriction_bins"),
    "operators.balance": ("Balance", "ConvergenceWarning", "balance", "balance_large"),
    "operators.ingest": ("InvalidPairs", "aggregate_records", "pixels_from_any", "pixels_from_pairs", "sanitize_pixels", "sanitize_records", "validate_pixels"),
    "operators.pipe": ("split",),
    "operators.query": ("annotate", "balanced", "fill_lower"),
    "operators.reduce": ("coarsen_pixels", "merge_pixels"),
    "plans.genome": ("Genome",),
    "plans.regions": ("parse_number", "parse_region"),
    "plans.resolutions": ("preferred_sequence",),
    "sources.collection": ("ContactMatrix", "coarsen", "copy", "create", "create_cells", "is_cells", "is_matrix", "is_multires", "list_cells", "list_matrices", "merge", "zoomify"),
    "sources.text": ("read_bg2", "read_chromsizes", "read_coo", "read_fasta", "read_pairs"),
}
_HOME_OF = {name: home for home, names in _HOMES.items() for name in names}
__all__ = sorted(_HOME_OF)


def __getattr__(name: str):
    if name not in _HOME_OF:
        raise AttributeError(name)
    return getattr(import_module(f".{_HOME_OF[name]}", __name__), name)
