"""weftline: cleaning, combining, scoring and selecting line-aligned text corpora on Spark."""
