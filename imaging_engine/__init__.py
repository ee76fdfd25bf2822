"""Imaging-metadata analytics as DataFrame operators."""
