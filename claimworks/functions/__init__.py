"""Subpackage of the claim analytics engine."""
