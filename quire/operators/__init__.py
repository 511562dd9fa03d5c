"""operators of the page-document engine."""
