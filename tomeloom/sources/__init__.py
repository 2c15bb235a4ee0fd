"""Readers and writers of filings, expectations and results."""
