"""Governance of a registry of people as Spark DataFrame operators."""

from consentry.spec import DEFAULT_SPEC, RegistrySpec

__all__ = ["DEFAULT_SPEC", "RegistrySpec"]
