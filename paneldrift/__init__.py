"""Panel change analytics on Spark: units over time, their areas, and where totals changed."""
