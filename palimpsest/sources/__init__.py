"""Sources and sinks: landed files of all record shapes, binary attachments, snapshots, reports."""
