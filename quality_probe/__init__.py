"""Measure where text-quality scorers rank benchmark items hidden in a web corpus."""
