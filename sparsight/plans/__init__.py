"""Operators composed into whole flows, and the registered queries."""
