"""Collects every registered query."""
from thawline.plans import q_climate, q_grid, q_models, q_readings, q_sources, q_spikes  # noqa: F401
from thawline.plans.registry import ORACLES, QUERIES  # noqa: F401
