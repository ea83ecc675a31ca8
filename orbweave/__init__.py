"""A content-addressed spatial analytics engine on Spark DataFrames."""
