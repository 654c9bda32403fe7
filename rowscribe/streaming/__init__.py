"""Notes and prompts over streams. Serialization is a projection, so a streaming
DataFrame takes the same functions as a table."""
