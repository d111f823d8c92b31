"""Perturbation-stability analytics on Spark: DataFrame operators for the whole analysis."""
