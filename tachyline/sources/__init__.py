"""Where rows come from and go to: topics, wire formats, tables, catalogue."""
