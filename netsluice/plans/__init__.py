"""Jobs: the operators put together from source to sink."""
