"""All registered queries; importing the modules fills the registry."""

from tabspark.suite import features, measures, models, quality  # noqa: F401
from tabspark.suite.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
