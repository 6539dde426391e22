"""graphloom: a Spark-native knowledge-graph retrieval and analytics engine."""
