"""Corpus-preparation operators; nothing outside this folder imports them."""
