"""Readers and writers of sequence and feature files."""
