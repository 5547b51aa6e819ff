"""Spark ML stages and jobs: encoders, preprocessing, boosted trees, explanations."""
