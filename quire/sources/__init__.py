"""Where documents come from and go to."""
