"""DataFrame operators: snapshots, hierarchies, retrieval, quality, evidence, state."""
