"""Column functions: depth metrics, codecs and hashes."""
