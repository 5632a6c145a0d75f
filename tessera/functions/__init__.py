"""Statistical functions."""
