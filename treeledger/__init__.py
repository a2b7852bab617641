"""Versioned, content-addressed snapshots of hierarchical data as Spark tables."""
