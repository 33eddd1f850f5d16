"""Resumable batches."""
