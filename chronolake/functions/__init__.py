"""Part of the point-in-time engine."""
