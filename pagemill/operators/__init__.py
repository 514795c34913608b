"""Relational operators over documents, feeds and node tables."""
