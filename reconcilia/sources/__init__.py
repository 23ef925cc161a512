"""Inputs: word and page tables, OCR tokens, layout dimensions."""
