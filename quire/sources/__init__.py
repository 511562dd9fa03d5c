"""sources of the page-document engine."""
