"""Table analytics as Spark jobs: profile, clean, join, compare, explain, forecast, segment.

Every operator takes DataFrames and returns DataFrames. Nothing here collects
rows; only aggregates whose size is bounded by the number of columns, bins,
clusters or classes reach the driver.
"""
