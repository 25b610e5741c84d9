"""Readers and writers of annotation, prediction, image and text files."""
