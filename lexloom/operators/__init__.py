"""Relational operators over lexicon and text tables."""
