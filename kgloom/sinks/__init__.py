"""What the graph is written as."""
