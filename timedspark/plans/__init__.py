"""Queries over the driver tables, one function per registered name."""
