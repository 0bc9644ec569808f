"""Structured Streaming jobs over the same functions; watermarks and late data are extensions."""
