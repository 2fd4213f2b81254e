"""Named queries composed from the operators over the shared tables."""
