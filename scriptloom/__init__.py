"""Script localisation analytics on PySpark: extraction, translation, checks and patch building as DataFrame plans."""
