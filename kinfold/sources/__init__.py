"""Reading and writing of the jobs' tables."""
