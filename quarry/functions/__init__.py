"""Spark columns for the dialect's operators, scalar functions, aggregates and windows."""
