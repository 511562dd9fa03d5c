"""streaming of the page-document engine."""
