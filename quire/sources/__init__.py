"""Readers that turn files into ordered sections."""
