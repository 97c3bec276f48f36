"""DataFrame -> DataFrame operators. No actions in here."""
