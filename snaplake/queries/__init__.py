"""All registered queries."""

from snaplake.queries import enrichment, keyed, landing, lifecycle, market, rows, scoring, texts  # noqa: F401
from snaplake.queries.registry import QUERIES, SQL  # noqa: F401
