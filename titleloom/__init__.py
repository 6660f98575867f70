"""titleloom: clean, match and infer job titles with Spark DataFrames."""
