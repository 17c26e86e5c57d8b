"""Graph patterns as DataFrame plans."""
