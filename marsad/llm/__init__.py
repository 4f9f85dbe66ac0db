"""Training-data operators: one module each; ``catalog`` lists their queries and SQL."""
