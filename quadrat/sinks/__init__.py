"""Sinks: matrices, edge lists, linkages, JSON and profiles."""
