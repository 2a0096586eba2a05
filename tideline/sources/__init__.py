"""Where logs come from and where state is kept."""
