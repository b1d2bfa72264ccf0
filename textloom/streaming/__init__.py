"""Scanning of text streams; an extension, since every scan is stateless by row."""
