"""DataFrame operators: scanning, decoding, facts, graphs."""
