"""Stream sketches, exact aggregates and byte-budget planning as Spark DataFrame operations."""
