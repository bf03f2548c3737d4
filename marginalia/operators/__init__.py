"""DataFrame operators: chunking, graph, memory, search, evidence, answers."""
