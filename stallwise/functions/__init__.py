"""Column functions: null rules, texts and dates."""
