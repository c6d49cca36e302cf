"""Subscription analytics warehouse on Spark.

Layers: L0 sources (``subledger.sources``) -> L1 cleaning views and L2 business
tables (``subledger.plans.layers``) -> L3 reports (``subledger.plans.reports``).
Every step is a function from DataFrames to a DataFrame; the driver never
holds data.
"""

from subledger.plans.warehouse import Warehouse

__all__ = ["Warehouse"]
