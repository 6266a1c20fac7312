"""Plan helpers: shared tables that cut lineage, path-pattern compiler."""
