"""Readers, writers and fixture frames derived from the driver tables."""
