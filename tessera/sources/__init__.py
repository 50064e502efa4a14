"""Files and manifests as tables."""
