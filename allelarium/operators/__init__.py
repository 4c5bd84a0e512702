"""Operators on call sets: filters, joins, concordance, sample statistics."""
