"""Quarryline: set-semantics relational rules, recursion and incremental views as Spark jobs."""
