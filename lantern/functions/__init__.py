"""Lantern: functions."""
