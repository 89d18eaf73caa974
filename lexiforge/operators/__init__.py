"""Operators over DataFrames of words: dictionaries, features, potentials, decoding, candidates, training and metrics."""
