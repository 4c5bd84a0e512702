"""Readers and writers of call sets, variant lists, intervals and results."""
