"""Part of spanlake."""
