"""All query modules, imported once so that they register themselves."""

from tidemark.plans import association, basics, contrasts, events, forecast, inference, market, outcomes, streams  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES, run  # noqa: F401
