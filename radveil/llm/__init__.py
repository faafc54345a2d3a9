"""Operators for preparing training text and large-scale record matching; nothing else imports this package."""
