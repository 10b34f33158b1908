"""Readers and writers of the file formats the tables live in."""
