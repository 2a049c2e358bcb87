"""Operators for preparing training text, each usable on any DataFrame."""
