"""Composed plans: batch answering, test views, registered queries and their SQL twins."""
