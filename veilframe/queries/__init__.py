"""Named queries and their SQL for the driver."""
