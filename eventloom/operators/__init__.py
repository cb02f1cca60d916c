"""DataFrame -> DataFrame operators: loss, routing, rotation, metrics, checks, bench analytics."""
