"""All traffic queries: importing a module of queries registers them."""

from flowloom.plans import catalog, packet_queries, scoring, threat_queries, training_queries  # noqa: F401

queries, oracle_sql = catalog.queries, catalog.oracle_sql
