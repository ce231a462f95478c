"""Incremental runs over arriving manifests."""
