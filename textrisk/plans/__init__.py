"""Composite jobs: scan, train, freeze, predict, evaluate."""
