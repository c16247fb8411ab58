"""Statistics of relations and what is estimated from them."""
