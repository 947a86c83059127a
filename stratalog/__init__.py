"""Catalogue analytics in bronze, silver and gold layers, as Spark DataFrame functions."""
