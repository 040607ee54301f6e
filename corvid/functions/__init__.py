"""Column functions: text, messages, judge responses, names and numbers."""
