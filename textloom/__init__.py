"""Textloom: corpus cleaning and preparation as Spark DataFrame transforms."""
