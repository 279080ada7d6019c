"""PySpark engine that finds, scores and masks personal data in text columns."""
