"""Queries made of the operators, and the SQL that says the same."""
