"""Operators for building training data from crawled text, one module each."""
