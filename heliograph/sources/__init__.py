"""Readers: tables, image headers, lookup tables, tensor files and packages."""
