"""Tabular machine-learning data work as Spark operators.

Every operator takes DataFrames and returns DataFrames or Spark ML stages.
The driver sees only small summaries whose size does not grow with the rows.
"""

from tabspark.config import EngineConfig

__all__ = ["EngineConfig"]
__version__ = "0.1.0"
