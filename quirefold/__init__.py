"""Document processing on Spark DataFrames: labelled chunks in, clean ordered paragraphs out."""
