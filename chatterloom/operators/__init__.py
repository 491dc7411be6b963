"""Set-at-a-time operators over threads, users and profiles."""
