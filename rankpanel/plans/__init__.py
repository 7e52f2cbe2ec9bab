"""Compositions of operators: features, training, prediction, evaluation."""
