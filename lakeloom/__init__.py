"""lakeloom: preparing, sampling, auditing and scoring training corpora with Spark DataFrames."""
