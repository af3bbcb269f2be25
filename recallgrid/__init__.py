"""recallgrid: note-collection analytics on Spark DataFrames."""
