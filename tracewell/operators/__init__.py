"""Operators over frame tables: windows, selection, joins, aggregates, rules."""
