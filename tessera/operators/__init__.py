"""Relational operators over measurement records and planar images."""
