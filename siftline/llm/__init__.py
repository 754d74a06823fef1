"""Corpus preparation for language-model training: ten operators over tables of documents."""
