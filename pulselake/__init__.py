"""pulselake: long-term electrocardiogram tables as Spark DataFrames."""
