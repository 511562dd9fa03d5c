"""functions of the page-document engine."""
