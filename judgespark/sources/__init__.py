"""Readers for evaluation files and writers for results."""
