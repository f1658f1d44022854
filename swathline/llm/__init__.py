"""Operators of a training-data pipeline over the survey platform's records (notes, messages, webhooks, descriptors)."""
