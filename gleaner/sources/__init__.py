"""Readers, writers and path predicates."""
