"""Operators for training-data pipelines: tokens, duplicates, personal data, language, pages and licences."""
