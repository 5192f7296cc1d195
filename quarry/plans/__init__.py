"""Binding of syntax trees to logical plans, and plans to DataFrames."""
