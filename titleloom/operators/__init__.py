"""DataFrame operators: joins, groupings and windows of the engine."""
