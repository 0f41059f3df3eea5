"""Operators for building training corpora: fingerprints, filters, extraction, archives, shards, scans."""
