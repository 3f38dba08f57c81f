"""Named queries over the driver tables (Spark side) and their SQL oracles."""

from corvid.plans.catalog import QUERIES
from corvid.plans.oracle import ORACLE_SQL

__all__ = ["QUERIES", "ORACLE_SQL"]
