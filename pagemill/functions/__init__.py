"""Scalar functions: URLs, Unicode, escaping, encodings, languages, dates."""
