"""All queries of the engine's own operators and their SQL, by name."""

from sedimenta import registry, registry_namespace, registry_traces  # noqa: F401  importing them registers their queries
from sedimenta.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
