"""Operators for large text collections, and their registered queries."""
