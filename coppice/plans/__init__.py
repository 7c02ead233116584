"""Queries that bind the operators to tables, each with the SQL it must agree with."""
