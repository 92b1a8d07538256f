"""Whole analyses and the catalogue of registered queries."""
