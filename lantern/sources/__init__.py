"""Lantern: sources."""
