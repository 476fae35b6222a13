"""The stateless operators on streams, and running counts of the tag graph."""
