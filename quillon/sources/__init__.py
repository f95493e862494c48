"""Where rows come from and where tables live: source registry, REST and bulk clients, CSV scans, snapshot store."""
