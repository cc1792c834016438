"""Every query by name, with its SQL twin where SQL can state it."""

from . import answers, checks, directions, estimates, extraction, flows, lineage, reasoning, records, relations, scenes, scoring, selection, texts, wording  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

FLAGSHIP = "score_three_class"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
