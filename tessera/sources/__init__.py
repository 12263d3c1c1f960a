"""Readers and writers of record files and images."""
