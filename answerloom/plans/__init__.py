"""Whole-workflow plans and the registered query catalogue."""
