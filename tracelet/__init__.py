"""Sequence analytics on Spark: Markov models, detection, ranking and scoring as relational plans."""
