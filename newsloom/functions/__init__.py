"""Column functions: text, URLs, dates, keys and HTML."""
