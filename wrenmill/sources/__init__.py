"""Readers and writers: JSONL, JSON, NPZ, YAML."""
