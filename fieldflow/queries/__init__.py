"""All registered queries."""

from fieldflow.queries import assessing, ingest, joining, planning  # noqa: F401
from fieldflow.queries.registry import ORACLES, QUERIES  # noqa: F401
