"""Skew-aware graph, matrix and irregular-workload analytics as DataFrame plans."""
