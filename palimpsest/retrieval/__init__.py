"""Indexes that are kept in folders, exact fused top-k search over them, and a retriever of one call."""
