"""waxcrate: music-library preparation at catalogue scale, on Spark DataFrames."""
