"""Readers of image folders, label tables and manifests, and writers of results."""
