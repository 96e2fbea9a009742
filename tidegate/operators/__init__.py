"""Relational operators: ledgers, joins, gates, scores and orderings."""
