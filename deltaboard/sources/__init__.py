"""Feed readers, versioned tables and outboxes."""
