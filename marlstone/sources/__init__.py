"""Where rows come from: bound tables and versioned snapshots."""
