"""Participation analytics on Spark: DataFrame-to-DataFrame operators planned by Catalyst."""
