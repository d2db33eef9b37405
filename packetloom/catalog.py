"""All registered queries of the engine's own operators, each with its SQL twin where SQL can express it."""

from .plans import correlation, report, scoring, sessions, statistics, toolkit, webshell  # noqa: F401
from .plans import packets  # noqa: F401  isort: skip
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
