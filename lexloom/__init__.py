"""lexloom: bilingual lexical analytics as DataFrame-to-DataFrame functions on Spark."""
