"""Readers and writers at the edge of the pipeline."""
