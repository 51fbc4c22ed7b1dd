"""Conversational analytics on Spark: operators over transcripts, calls, contacts, passages and vectors."""
