"""lakeweave: discovery of joinable, duplicate and correlated tables in a data lake, on Spark."""
