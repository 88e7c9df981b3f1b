"""End-to-end pipelines: example builders, chat modes, retriever evaluation."""
