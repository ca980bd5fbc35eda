"""Leakage-free sports-style analytics on Spark: ratio events, as-of joins, ratings, markets, simulation."""
