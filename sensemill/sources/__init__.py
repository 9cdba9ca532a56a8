"""Readers of dictionary, word-list and synset files, and keyed sinks."""
