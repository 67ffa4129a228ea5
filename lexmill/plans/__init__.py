"""Plans: whole corpus builds, artifacts with manifests, validation and resumption."""
