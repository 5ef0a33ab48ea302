"""Facts to marts, as DataFrame to DataFrame."""
