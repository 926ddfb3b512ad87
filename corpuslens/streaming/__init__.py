"""The row-wise steps on a stream of cleaned threads."""
