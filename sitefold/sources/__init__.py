"""Scans and sinks for site rows, manifests, truth records, curves and moment tables."""
