"""Operators for preparing training text: cleaning, deduplication, mixing, formatting, output."""
