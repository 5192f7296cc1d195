"""A SELECT engine on Spark: its own SQL front end, Catalyst behind it."""
