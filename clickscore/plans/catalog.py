"""Registered queries: one Spark callable and (where SQL can say it) one

Every query reads the driver's tables for the given scale-factor folder and
runs over all of their rows.  Check views emit arrays as joined strings and
round doubles to 6 decimals in *both* engines so the order-insensitive value
hash compares like with like.
"""

from __future__ import annotations

from clickscore.plans.registry import REGISTRY, Entry, joined, register  # noqa: F401

# import the query modules so their @register calls run
from clickscore.plans import q_base, q_describe, q_model, q_ngrams, q_ranks, q_sessions, q_sinks, q_validate  # noqa: E402,F401

q_sinks.register_exports()          # of what the other modules registered
