"""Every query over the driver tables."""

from __future__ import annotations

from .base import Query
from . import product_queries, reply_queries, state_queries

ALL: dict[str, Query] = {**product_queries.QUERIES, **state_queries.QUERIES, **reply_queries.QUERIES}
