"""Column expressions: bins, genotype calls, genome positions, guarded arithmetic."""
