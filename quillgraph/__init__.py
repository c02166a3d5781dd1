"""quillgraph: graph-aware retrieval and schema reasoning as DataFrame programs."""
