"""Relational building blocks: joins, components, blocking, survivorship."""
