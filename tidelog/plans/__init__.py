"""Building blocks of plans: shared scratch tables and global ranks without a single-task window."""
