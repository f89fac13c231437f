"""Lantern: plans."""
