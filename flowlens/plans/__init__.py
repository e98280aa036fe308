"""Registered queries: the operators wired to the driver's tables."""
