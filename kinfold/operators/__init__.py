"""The jobs' steps, from DataFrame to DataFrame."""
