"""Relational operators as DataFrame operations; Catalyst picks the physical ones."""
