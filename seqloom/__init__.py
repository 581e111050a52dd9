"""seqloom: sequence files and training corpora as DataFrames."""
