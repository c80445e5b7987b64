"""Registered queries over the given tables, each beside its SQL equivalent."""
