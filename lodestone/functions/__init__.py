"""Column functions: text, personal data, rules."""
