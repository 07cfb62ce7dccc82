"""Sources and sinks: sheets, JSON, pages, snapshots, calendars, site maps and documents."""
