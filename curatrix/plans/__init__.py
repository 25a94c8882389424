"""Whole jobs: a recipe to a split, and probe results to a training set."""
