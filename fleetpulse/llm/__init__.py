"""Training-data operators (ten of them) and their registered queries.  Nothing outside imports this package."""
