"""Relational operators over interval, word, frame, reply and store tables."""
