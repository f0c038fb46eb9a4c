"""Where points come from and go to."""
