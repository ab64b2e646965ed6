"""Bindings of the operators to the star-schema tables; importing it registers every query."""

from helixframe.plans import aligned, outputs, queries, reads, rules, solo  # noqa: F401
