"""The registered queries, one module per part of the library."""

from tastegraph.demo.catalog import columns, flow, graph, ingest, merges, people, views  # noqa: F401
