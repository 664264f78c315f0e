"""Readers that turn files and star-schema tables into fact rows."""
