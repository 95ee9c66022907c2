"""Registered queries over the given tables, and their SQL twins."""

from importlib import import_module

MODULES = ("filter_queries", "triage_queries", "compare_queries", "capture_queries", "ingest_queries", "stream_queries")


def all_queries():
    from emberlog.plans import registry
    for name in MODULES:
        import_module(f"emberlog.plans.{name}")
    return dict(registry.QUERIES)
