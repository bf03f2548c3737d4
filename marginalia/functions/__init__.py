"""Column expressions: text cleaning, identity, dates and numbers."""
