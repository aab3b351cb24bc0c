"""Queries over the given tables, one or more per inventory entry, with SQL twins."""

from workload import q_graph, q_ip, q_jobs, q_joins, q_sources, q_text, q_traces  # noqa: F401
from workload.registry import ORACLES, QUERIES  # noqa: F401
