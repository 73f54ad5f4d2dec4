"""Whole plans: feature panels, run-time feature vectors, fire rules, cards, serving queries."""
