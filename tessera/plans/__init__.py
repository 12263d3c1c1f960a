"""Choices among priced candidates."""
