"""Space-time risk analytics as DataFrame operators on Spark.

Operators take and return DataFrames over (location, time) tables and
(label, score) tables. Nothing here runs an action except model fits and the
operators whose docstring says so.
"""
