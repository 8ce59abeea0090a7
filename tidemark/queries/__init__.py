"""All registered queries."""

from tidemark.queries import cleaning, knowledge, live, optionry, scalars, series, trading  # noqa: F401
from tidemark.queries.registry import OPERATORS, ORACLES, QUERIES  # noqa: F401
