"""Whole runs: configuration, representative selection, sketching, packing, reports, command line."""
