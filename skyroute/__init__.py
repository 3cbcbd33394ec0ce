"""Spark jobs for aircraft route planning and aerial-image data preparation."""
