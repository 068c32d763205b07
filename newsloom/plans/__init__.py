"""Plan-level helpers: durable cuts of a lineage, and graph components."""
