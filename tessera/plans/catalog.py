"""Imports every query family so that the registry is complete."""

from tessera.plans import q_boosting, q_correlate, q_distributions, q_evaluate, q_history, q_linear, q_models, q_pairwise, q_prepare, q_profile  # noqa: F401

FLAGSHIP = "profile_describe"
