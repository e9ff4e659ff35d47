"""Column functions: URLs, text and HTML, fuzzy matching, highlighting, SQL registration."""
