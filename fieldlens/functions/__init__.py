"""Column functions: text, dates, check digits, similarity, geometry."""
