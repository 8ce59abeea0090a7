"""Plan building blocks shared by the operators."""

from tidemark.plans.blocks import (  # noqa: F401
    Axis,
    asof,
    latest_by,
    rolling,
    scan,
    settle,
    shift,
    trailing,
    with_blocks,
)
