"""Sources: JSONL folders, token binaries, chat sources, and generated tables."""
