"""Detectors and repairs; every one takes and returns DataFrames."""
