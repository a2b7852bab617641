"""Plans over whole hierarchies: flatten, Merkle hashes, closures."""
