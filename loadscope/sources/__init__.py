"""Readers and writers for logs, corpora, traces and result files."""
