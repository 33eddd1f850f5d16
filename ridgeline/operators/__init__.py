"""Transforms of collections, runs and question sets."""
