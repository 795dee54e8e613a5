"""Support-ticket analytics and text triage as Spark DataFrame operators."""
