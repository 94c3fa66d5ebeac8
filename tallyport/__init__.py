"""Table synchronisation, change-log replay and data reconciliation as Spark plans."""
