"""Registered queries; importing this package registers all of them."""

from folioscope.plans import catalog_queries, graph_queries, more_queries, registry, retrieval_queries, store_queries, text_queries, workflow_queries

__all__ = ["catalog_queries", "graph_queries", "more_queries", "registry", "retrieval_queries", "store_queries", "text_queries", "workflow_queries"]
