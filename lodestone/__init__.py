"""lodestone: code facts and corpus operators as Spark DataFrames."""
