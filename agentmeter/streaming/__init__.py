"""The live path."""
