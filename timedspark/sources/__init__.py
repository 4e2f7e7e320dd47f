"""Readers and writers for transcripts, manifests, sidecars, receipts and probes."""
