"""strandloom: a Spark-native engine for long-sequence mapping and corpus preparation."""
