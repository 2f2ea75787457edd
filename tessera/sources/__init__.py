"""Where rows come from: adapters over relational tables, workspaces of files, manifests."""
