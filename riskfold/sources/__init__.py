"""Scans, sinks and the fixture views derived from the driver tables."""
