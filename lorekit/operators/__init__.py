"""Relational operators: joins, aggregates and rankings over the entities of a documentation corpus."""
