"""Registered queries: each a Spark plan, with the SQL that must give the same rows."""
