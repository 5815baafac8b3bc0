"""Part of glyphflow: sources."""
