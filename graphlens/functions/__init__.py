"""Column functions: distinct collections, match positions and lines, paths."""
