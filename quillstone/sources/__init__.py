"""Tables: catalog, snapshot storage, CSV loading, rendered output."""
