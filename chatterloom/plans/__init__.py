"""Multi-operator jobs: compaction, context assembly, memory, edits."""
