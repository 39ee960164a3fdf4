"""Views and the query registry."""
