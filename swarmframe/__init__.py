"""DataFrame and Structured Streaming operators for fleets of cameras."""
