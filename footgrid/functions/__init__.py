"""Codes, column expressions and small helpers."""
