"""DataFrame operators of the document engine."""
