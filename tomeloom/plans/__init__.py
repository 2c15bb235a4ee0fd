"""Whole plans: the filing corpus, the extraction, and the registered queries."""
