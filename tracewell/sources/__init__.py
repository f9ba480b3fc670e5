"""Tables and records at rest."""
