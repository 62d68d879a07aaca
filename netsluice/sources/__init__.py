"""Readers and writers: files, landing folders, topics."""
