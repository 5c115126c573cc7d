"""Queries over the supplied tables with the SQL they must equal."""
