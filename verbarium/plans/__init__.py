"""Session, shared storage and physical-plan helpers."""
