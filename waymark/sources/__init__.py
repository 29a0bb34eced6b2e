"""Readers and writers of clouds, trajectories, metadata and request documents."""
