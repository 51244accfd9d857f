"""Text of statements to typed plans."""
