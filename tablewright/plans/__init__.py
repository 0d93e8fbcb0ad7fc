"""Decisions, fitted repair plans, validation and reports."""
