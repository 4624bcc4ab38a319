"""Column to Column functions: regular expressions, minifiers, tokens, formats."""
