"""Operators for preparing training data at corpus scale; nothing outside imports this package."""
