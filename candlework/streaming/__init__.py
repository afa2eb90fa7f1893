"""The live path: Structured Streaming with bounded state per symbol."""
