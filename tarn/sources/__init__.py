"""Storage and readers."""
