"""Named plans over the driver's tables, with DuckDB SQL for each where SQL can say it."""

from gristmill.plans import aggregates, extraction, filters, joins, matching, quality, resolution, rule_tables, scalars, sinks, views, windows  # noqa: F401  they register their plans
from gristmill.plans.registry import ORACLE as CORE_ORACLE
from gristmill.plans.registry import QUERIES as CORE_QUERIES
from gristmill.plans.search import flagship

__all__ = ["CORE_ORACLE", "CORE_QUERIES", "flagship"]
