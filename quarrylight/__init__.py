"""Enterprise profiles from pages and texts, as DataFrame operators."""
