"""Spark-native analytics over a football knowledge graph: sources, operators, plans, streams."""
