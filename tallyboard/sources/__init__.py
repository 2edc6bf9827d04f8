"""Reading dumps and tables, importing them, publishing snapshots."""
