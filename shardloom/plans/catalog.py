"""All registered queries."""

from shardloom.plans import (  # noqa: F401
    barriers,
    checkpoints,
    delivery,
    placement,
    requests,
    streams,
    tasks,
    training,
    workers,
)
from shardloom.plans.registry import ORACLES, QUERIES  # noqa: F401
