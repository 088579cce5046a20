"""All registered queries."""

from .registry import QUERIES, SQL
from . import baselines, detect, records, repair, runs, transfer  # noqa: F401
from .runs import scorecard_of_orders  # noqa: F401
