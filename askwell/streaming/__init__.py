"""Jobs over growing logs."""
