"""Readers and writers of scripts, entries, translations and patches."""
