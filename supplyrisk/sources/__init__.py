"""Typed scans, sinks and the binding to the driver test tables."""
