"""Subpackage of scrivena; see README.md for its contents."""
