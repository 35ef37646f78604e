"""Spark-first queries over a media catalogue: filters, folder tree, search, edit history and image statistics."""
