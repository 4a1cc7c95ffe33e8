"""provender: a Spark-native entity-resolution and nutrition analytics engine."""
