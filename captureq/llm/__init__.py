"""Operators for preparing training text; nothing else in captureq imports this package."""
