"""Whole experiments and the registered queries."""
