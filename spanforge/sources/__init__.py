"""Readers and writers of annotated records, runs and manifests."""
