"""Column expressions: text, grading and arithmetic."""
