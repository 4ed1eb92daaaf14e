"""Readers and writers: web corpus, benchmark items, stores and reports."""
