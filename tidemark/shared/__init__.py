"""Building blocks that several operators share."""
