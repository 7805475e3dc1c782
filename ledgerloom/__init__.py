"""ledgerloom: verifiable facts, graphs and documents as Spark DataFrames."""
