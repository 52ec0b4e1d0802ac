"""Spark operators for runny permutations and run-length Burrows-Wheeler transforms."""
