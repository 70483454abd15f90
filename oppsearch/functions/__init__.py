"""Column expressions: cleaning, text composition, chunking, routing, profile, cards."""
