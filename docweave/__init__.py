"""docweave: incrementally maintained, denormalised read models on Spark."""
