"""Operators: sampling, vocabulary, encoders, exact and clustered search, evaluation, generation."""
