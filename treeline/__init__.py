"""Conjunctive queries by hypertree decompositions, answered with DataFrame operations."""
