"""Column functions: small expressions with no shuffle of their own."""
