"""plans of the page-document engine."""
