"""All registered queries."""

from wiregrain.plans.queries import (  # noqa: F401
    attacks,
    flows,
    learning,
    packets,
    robust,
    rolling,
    rules,
    statistics,
    streams,
)
from wiregrain.plans.queries.registry import ORACLES, QUERIES  # noqa: F401
