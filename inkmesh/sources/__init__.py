"""Sources and sinks: views of the test tables, snapshots, documents, logs."""
