"""Sources and sinks: commit logs, event files and audit trails."""
