"""gridloom: a Spark-native engine for ordered event sequences, segments, vectors and orderings."""
