"""Part of glyphflow: operators."""
