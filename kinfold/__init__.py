"""Spark jobs from coded surveys to personas, and from dialogues to score tables."""
