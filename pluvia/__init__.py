"""Spark-native hydro-climate analytics: sources, operators, drought functions and streaming ingestion."""
