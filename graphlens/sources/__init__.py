"""Readers: source trees as text rows, file listings, JSON record batches, project configuration."""
