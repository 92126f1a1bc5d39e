"""Batch analytics over community content, expressed as Spark DataFrame stages."""
