"""The catalogue of queries over the driver's tables, each with its SQL twin.

Each module of plans registers its queries here. Stand-ins: benchmark passages are queries and documents candidates of
lexical ranking; four consecutive vectors are the sections of one document; suppliers are candidates with brands as
skills, customers are requirements; events stand for the outbox and the job table.
"""

from __future__ import annotations

from pairloom.plans import evaluations, hybrids, lexical, logs, pieces, services, texts, vectors  # noqa: F401
from pairloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
