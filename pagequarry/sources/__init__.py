"""Readers: corpora, HTML, robots.txt, sitemaps, saved reports."""
