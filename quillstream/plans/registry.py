"""Registry of the engine's own queries and of the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under `name`, with the SQL that gives the same rows."""

    def keep(function: Query) -> Query:
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return keep


from . import library_queries  # noqa: E402, F401  the modules register their queries
from . import job_queries  # noqa: E402, F401
from . import metadata_queries  # noqa: E402, F401
from . import page_queries  # noqa: E402, F401
from . import stream_queries  # noqa: E402, F401
from . import flow_queries  # noqa: E402, F401
from . import state_queries  # noqa: E402, F401
from . import audit_queries  # noqa: E402, F401
from . import store_queries  # noqa: E402, F401
from . import provider_queries  # noqa: E402, F401
