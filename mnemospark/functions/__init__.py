"""Column expressions: text, time, scores, JSON and vectors.  Nothing here needs a Python worker."""
