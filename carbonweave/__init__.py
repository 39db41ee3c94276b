"""carbonweave."""
