"""Query plans: market panels, profiling, model evaluation, and their oracles."""
