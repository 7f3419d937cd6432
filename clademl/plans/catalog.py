"""Imports every query module so that the registry is complete."""

from . import q_evaluation, q_genotypes, q_models, q_relational  # noqa: F401
