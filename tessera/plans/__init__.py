"""Queries: operators bound to the driver's tables, each with SQL that gives the same rows."""
