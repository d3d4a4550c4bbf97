"""Cohort analytics as Spark DataFrame plans: subjects x features, regions, permutation tests, networks."""

__version__ = "0.1.0"
