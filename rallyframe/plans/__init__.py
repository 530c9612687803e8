"""All registered queries of the contest domain."""

from rallyframe.plans import court, extra, imports, leaderboards, more, places, rules, sheets, solver, tables  # noqa: F401
from rallyframe.plans.registry import ORACLES, QUERIES  # noqa: F401
