"""Stream form of the chat loop."""
