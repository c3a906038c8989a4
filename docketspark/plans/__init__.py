"""The query catalogue: importing the modules fills the registry."""

from docketspark.plans import answers, documents, relational, retrieval, rules, sections, streaming, text  # noqa: F401
from docketspark.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
