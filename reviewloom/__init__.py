"""Customer-review analytics as Spark DataFrame jobs."""

from reviewloom.schema import ColumnMapping
from reviewloom.plans.analyze import analyze

__all__ = ["ColumnMapping", "analyze"]
