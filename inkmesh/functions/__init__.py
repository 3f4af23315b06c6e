"""Column functions: text, JSON replies, Markdown, view geometry."""
