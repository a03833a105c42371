"""Sources of recorded product pages."""
