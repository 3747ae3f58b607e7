"""Reading machine logs and writing results."""
