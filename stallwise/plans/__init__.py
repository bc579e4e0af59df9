"""The four jobs end to end."""
