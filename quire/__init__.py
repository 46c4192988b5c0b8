"""quire: document analytics (pages, lines, words, readings, edits, pixels) on Spark DataFrames."""
