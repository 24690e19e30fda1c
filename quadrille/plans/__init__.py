"""Graph queries: syntax tree, rewriting, execution."""
