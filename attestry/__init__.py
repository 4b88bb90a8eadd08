"""Spark jobs over AI decision records, and the text work of a training-data pipeline."""
