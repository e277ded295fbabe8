"""Listings, sidecar state and remote listings."""
