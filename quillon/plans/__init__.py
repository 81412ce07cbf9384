"""Filter expressions and their plans: columns, bitmap tests and posting algebra."""
