"""Part of glyphflow: plans."""
