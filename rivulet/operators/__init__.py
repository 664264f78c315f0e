"""DataFrame operators over facts, bridges and derived tables."""
