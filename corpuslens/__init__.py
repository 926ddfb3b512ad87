"""Mining and lexical retrieval over discussion-forum corpora, on Spark DataFrames."""
