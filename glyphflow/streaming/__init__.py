"""Part of glyphflow: streaming."""
