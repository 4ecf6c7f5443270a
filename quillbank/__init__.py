"""quillbank: a question-bank engine on Spark DataFrames."""
