"""Lantern: streaming."""
