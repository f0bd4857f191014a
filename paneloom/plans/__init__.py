"""Registered queries: operators bound to the given tables, each with a comparison SQL."""
