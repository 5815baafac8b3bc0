"""glyphflow: multilingual text, lexicon and corpus analytics as Spark plans."""
