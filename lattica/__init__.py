"""Lattica: affinity-lattice segmentation and contact-graph clustering on Spark DataFrames."""

__version__ = "0.1.0"
_HOMES = {
    "lattica.functions.thresholds": ("AFF_THRESHOLDS", "affinity_to_scores", "grade_voi", "resolve_thresholds", "scores_to_affinity", "voi_limits"),
    "lattica.plans.api": (
        "DevBuf", "agglomerate", "agglomerate_scores", "cuda_libs_ready", "evaluate", "fragments", "from_torch", "labels_from_fragments",
        "missing_cuda_libs", "region_graph", "require_cuda_libs", "segment", "segment_d", "segment_frames", "to_torch",
    ),
}
__all__ = sorted(name for names in _HOMES.values() for name in names)


def __getattr__(name: str):
    """Names are imported when they are first asked for, so that workers load only what they run."""
    from importlib import import_module

    for home, names in _HOMES.items():
        if name in names:
            return getattr(import_module(home), name)
    raise AttributeError(f"module 'lattica' has no attribute {name!r}")
