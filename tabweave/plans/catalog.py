"""Imports the modules that register queries."""

from . import q_encode, q_fidelity, q_privacy, q_profile, q_ranking, q_sampling, q_sources, q_utility  # noqa: F401
