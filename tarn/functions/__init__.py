"""Column functions of the text-context model."""
