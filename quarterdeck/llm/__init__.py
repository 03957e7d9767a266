"""Operators of a training-data pipeline: packing, quality, chat, near-duplicates, mixing, licences, secrets, languages."""
