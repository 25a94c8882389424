"""Readers and writers of samples, pages, recipes, bitext and predictions."""
