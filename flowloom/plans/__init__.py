"""Helpers that shape a job's physical plan: table loading, lineage cuts, loops to a fixpoint."""
