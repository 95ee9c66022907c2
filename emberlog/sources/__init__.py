"""Readers and writers of captures and their exports."""
