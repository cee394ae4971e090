"""docspark: user-level Spark operators over collections of business documents."""
