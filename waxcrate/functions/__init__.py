"""Part of the waxcrate library."""
