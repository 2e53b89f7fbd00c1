"""Files read and written, and versioned tables on shared storage."""
