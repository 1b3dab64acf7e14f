"""Column-level building blocks: portable randomness, text, names, quantile specs."""
