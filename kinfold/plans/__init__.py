"""The workloads put together, over survey-shaped views of the given tables."""
