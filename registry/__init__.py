"""The registered queries, the frames they read, and their SQL."""
