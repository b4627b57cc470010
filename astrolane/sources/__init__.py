"""Datasets on disk: manifests, scans, writers, loaders and the database."""
