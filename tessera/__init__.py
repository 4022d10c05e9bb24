"""tessera: Spark-native planning, tile arithmetic, queue state and corpus operators."""
