"""Reading site files, writing reports."""
