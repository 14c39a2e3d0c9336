"""Files and saved models."""
