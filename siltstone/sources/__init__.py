"""Where rows come from and go to: adapters of the driver's tables, transfer files, archives and transcripts."""
