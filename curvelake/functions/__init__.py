"""Column-level building blocks and scalar functions."""
