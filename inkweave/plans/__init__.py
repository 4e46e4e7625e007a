"""All registered queries of the engine."""

from ..registry import ORACLES, QUERIES
from . import cluster_queries, graph_queries, prompt_queries, python_queries, qa_queries, rule_queries, status_queries, store_queries, stream_queries, text_queries

__all__ = ["ORACLES", "QUERIES", "cluster_queries", "graph_queries", "prompt_queries", "python_queries", "qa_queries", "rule_queries", "status_queries", "store_queries", "stream_queries", "text_queries"]
