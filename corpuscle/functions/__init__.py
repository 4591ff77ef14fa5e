"""Column functions: built-in expressions, and Arrow-batched functions where those can't say it."""
