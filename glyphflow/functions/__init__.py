"""Part of glyphflow: functions."""
