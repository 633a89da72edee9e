"""folio: a Spark-native document retrieval and evidence engine."""
