"""Readers and writers of the files the pipeline exchanges."""
