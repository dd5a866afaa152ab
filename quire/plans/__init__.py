"""Layout and batch plans."""
