"""DataFrame rewrites that keep hot keys and global orders distributed."""
