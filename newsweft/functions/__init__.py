"""Column functions: text, urls, scoring, numbers and salvage of raw output."""
