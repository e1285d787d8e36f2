"""Formats read and written: page XML, annotation JSON, file lists and text files."""
