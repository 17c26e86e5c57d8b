"""Operators beyond plain DataFrame calls: joins on prefixes, graph mutation, text extraction."""
